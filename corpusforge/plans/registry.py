"""The registry of queries and what their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusforge.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else "true" if v is True else "false" if v is False else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


# SQL forms of the text functions
def sql_tokens(text: str, stop: list[str] = T.STOP_WORDS) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9.+#-]+'), lambda x: trim(x, '.-')), lambda x: (length(x) >= 3 OR contains(x, '#') OR contains(x, '+')) AND x NOT IN ({sql_list(stop)})))"


SPACE = r"[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]"


def sql_key(text: str) -> str:
    return rf"trim(regexp_replace({sql_folded(text)}, '[.:;]+$', ''))"


def sql_folded(text: str) -> str:
    """Composed, white space collapsed, lower case; of the letters that fold otherwise than they lower, sharp s, long s, final sigma and the ligatures."""
    out = f"lower(trim(regexp_replace(nfc_normalize({text}), '{SPACE}+', ' ', 'g')))"
    for a, b in (("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def sql_lines(source: str, ids: str) -> str:
    """Lines of source (ids..., text) as ids..., line_no, line."""
    parts = r"string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
    return f"(SELECT {ids}, i AS line_no, parts[i] AS line FROM (SELECT {ids}, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT {ids}, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT {ids}, {parts} AS parts FROM {source}))))"
