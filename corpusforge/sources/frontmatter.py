"""Frontmatter of Markdown documents and its reconciliation across sources."""

from __future__ import annotations

import json
import textwrap

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fields that outputs carry from their sources (fixed values, as are the names in `declared`).
CARRIED = ["allowed-tools", "disallowed-tools", "disable-model-invocation", "compatibility", "metadata"]
TOOL = r"([A-Za-z_]\w*(?:\([^)]*\))?)"


def parse(text: str) -> tuple[dict, str]:
    """Fields and body. Flat lines are key: value, split at the first colon; an empty value takes the indented YAML below it.

    Nested blocks are read by the safe loader only; what isn't a mapping or list counts as an empty value. A text without an
    opening and a closing line of dashes is all body.
    """
    head, closed, body = text[4:].partition("\n---\n") if text.startswith("---\n") else ("", "", "")
    if not closed:
        return {}, text
    fields: dict = {}
    nested: str | None = None
    blocks: dict[str, list[str]] = {}
    for line in head.splitlines():
        if line[:1].isspace() or not line.strip():
            if nested is not None:
                blocks[nested].append(line)
            continue
        nested = None
        key, colon, value = (x.strip() for x in line.partition(":"))
        if line.startswith("#") or not colon or not key:
            continue
        fields[key] = value.strip("\"'")
        if not value:
            nested = key
            blocks[key] = []
    for key, lines in blocks.items():
        try:
            value = yaml.safe_load(textwrap.dedent("\n".join(lines)))
        except yaml.YAMLError:
            value = None
        fields[key] = value if isinstance(value, (dict, list)) else ""
    return fields, body


@F.pandas_udf(StringType())
def _fields(heads: pd.Series) -> pd.Series:
    return heads.map(lambda t: json.dumps(parse(t)[0], sort_keys=True, default=str))


def split_frontmatter(df: DataFrame, text: str = "text") -> DataFrame:
    """df with frontmatter (a JSON object as text) and body. Only what stands between the lines of dashes goes to Python."""
    whole = F.coalesce(F.col(text), F.lit(""))
    end = F.locate("\n---\n", whole, 5)
    has = whole.startswith("---\n") & (end > 0)
    head = F.when(has, F.substring(whole, F.lit(1), end + 4)).otherwise("")
    return df.withColumns({"frontmatter": F.when(has, _fields(head)).otherwise("{}"), "body": F.when(has, F.substring(whole, end + 5, F.length(whole))).otherwise(whole)})


def tool_tokens(value: str | Column) -> Column:
    return F.regexp_extract_all(F.col(value) if isinstance(value, str) else value, F.lit(TOOL), 1)


def declared(sources: DataFrame) -> DataFrame:
    """sources (with frontmatter, a JSON object as text) with allowed, disallowed (arrays; null if not declared), disable,
    compatibility and metadata (a map), as far as they say something.

    Tools are a list, or a string of tokens of which one in parentheses stays whole.
    """
    parsed = F.try_parse_json(F.coalesce("frontmatter", F.lit("{}")))

    def value(key: str) -> Column:
        return F.try_variant_get(parsed, f"$['{key}']", "string")

    def kind(key: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$['{key}']", "variant")), F.lit("VOID"))

    def tools(key: str) -> Column:
        listed = F.filter(F.transform(F.from_json(value(key), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
        text = value(key)
        empty = F.trim(F.coalesce(text, F.lit(""))).isin("", "[]", "{}", "null", "false")
        return F.when(~empty, F.when(kind(key).startswith("ARRAY"), listed).otherwise(tool_tokens(text)))

    compatibility = F.nullif(F.trim(value("compatibility")), F.lit(""))
    return sources.withColumns({
        "allowed": tools("allowed-tools"), "disallowed": tools("disallowed-tools"), "disable": F.coalesce(F.lower(F.trim(value("disable-model-invocation"))) == "true", F.lit(False)),
        "compatibility": F.when(~compatibility.isin("[]", "{}", "false"), compatibility), "metadata": F.when(kind("metadata").startswith("OBJECT"), F.from_json(value("metadata"), "map<string,string>")),
    })


def contributing_sources(layout: DataFrame, atoms: DataFrame) -> DataFrame:
    """child and skill of each source that an output's layout (cluster, atom_id) draws from, by atoms (id, skill) parsed again.

    Where two sources have an atom of one id, the later one by name is its source.
    """
    index = atoms.groupBy(F.col("id").alias("atom_id")).agg(F.max("skill").alias("skill"))
    return layout.join(index, "atom_id").select(F.col("cluster").alias("child"), "skill").distinct()


def reconcile_fields(sources: DataFrame) -> DataFrame:
    """One row for each child of sources (child, source_order, name, allowed array, disallowed array, disable boolean,
    compatibility): allowed tools that all declaring sources allow, disallowed by any, disabled by any, compatibility joined.

    Every field is a sum over (child, token): a tool that all allow is one that as many sources allow as declare any. No list
    of a child's sources is gathered, only the results, which are one field's text each. The metadata of sources is
    reconciled by `reconcile_metadata`.
    """
    children = sources.groupBy("child").agg(F.count_if(F.size("allowed") > 0).alias("declaring"), F.bool_or(F.coalesce("disable", F.lit(False))).alias("disable_model_invocation"))
    return _reconciled(sources, children)


def _reconciled(sources: DataFrame, children: DataFrame) -> DataFrame:
    allowed = sources.select("child", F.explode(F.array_distinct("allowed")).alias("token")).groupBy("child", "token").agg(F.count("*").alias("n")).join(children.select("child", "declaring"), "child")
    in_all = F.col("n") == F.col("declaring")
    shared = allowed.groupBy("child").agg(F.array_join(F.array_sort(F.collect_list(F.when(in_all, F.col("token")))), " ").alias("allowed_tools"), F.array_join(F.array_sort(F.collect_list(F.when(~in_all, F.col("token")))), ", ").alias("allowed_tools_dropped"))
    denied = sources.select("child", F.explode("disallowed").alias("token")).distinct().groupBy("child").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("disallowed_tools"))
    names = sources.filter("disable").select("child", "name").distinct().groupBy("child").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("disablers"))
    text = F.trim("compatibility")
    first = sources.filter(text != "").groupBy("child", text.alias("value")).agg(F.min("source_order").alias("source_order"))
    fits = first.groupBy("child").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_order", "value"))), lambda x: x.value), "; ").alias("compatibility"))
    out = children.drop("declaring")
    for part in (shared, denied, names, fits):
        out = out.join(part, "child", "left")
    columns = ["allowed_tools", "allowed_tools_dropped", "disallowed_tools", "disable_model_invocation", "disablers", "compatibility"]
    return out.fillna("", [c for c in columns if c != "disable_model_invocation"]).select("child", *columns)


def reconcile_metadata(entries: DataFrame) -> DataFrame:
    """child, key, value and differs of metadata (child, source_order, key, value): the first source's value stands."""
    return entries.groupBy("child", "key").agg(F.min_by("value", "source_order").alias("value"), (F.count_distinct("value") > 1).alias("differs"))


def carried_fields(contributing: DataFrame, sources: DataFrame) -> DataFrame:
    """cluster, field and value of the frontmatter that outputs carry from their sources.

    contributing: child, skill. sources: skill, source_order, frontmatter (JSON text), one row for each skill. A declared but
    empty list of tools counts as one that allows nothing.
    """
    own = contributing.join(declared(sources.select("skill", "source_order", "frontmatter")), "skill").withColumn("name", F.col("skill"))
    children = own.groupBy("child").agg(F.count_if(F.col("allowed").isNotNull()).alias("declaring"), F.bool_or("disable").alias("disable_model_invocation"))
    fields = _reconciled(own, children)
    texts = {"allowed-tools": F.col("allowed_tools"), "disallowed-tools": F.col("disallowed_tools"), "disable-model-invocation": F.when(F.col("disable_model_invocation"), F.lit("true")), "compatibility": F.col("compatibility")}
    pairs = fields.select(F.col("child").alias("cluster"), F.explode(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)])).alias("field", "value")).filter("value != ''")
    kept = reconcile_metadata(own.select("child", "source_order", F.explode("metadata").alias("key", "value")))
    written = kept.groupBy(F.col("child").alias("cluster")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("value"))
    return pairs.unionByName(written.select("cluster", F.lit("metadata").alias("field"), "value"))


def carry_findings(contributing: DataFrame, sources: DataFrame) -> DataFrame:
    """cluster, rule_id, severity and message of what carrying frontmatter narrowed, and notes (severity null) of what it joined."""
    own = contributing.join(declared(sources.select("skill", "source_order", "frontmatter")), "skill").withColumn("name", F.col("skill"))
    children = own.groupBy("child").agg(F.count_if(F.col("allowed").isNotNull()).alias("declaring"), F.bool_or("disable").alias("disable_model_invocation"))
    fields = _reconciled(own, children)
    row = lambda rule, severity, message: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).cast("string").alias("severity"), message.alias("message"))
    found = F.array_compact(F.array(
        F.when(F.col("allowed_tools_dropped") != "", row("merge:allowed-tools-narrowed", "medium", F.concat(F.lit("not allowed by every source: "), "allowed_tools_dropped"))),
        F.when(F.col("disallowed_tools") != "", row("merge:disallowed-tools-joined", None, F.concat(F.lit("disallowed by any source: "), "disallowed_tools"))),
        F.when(F.col("disable_model_invocation"), row("merge:invocation-disabled", "medium", F.concat(F.lit("disabled by: "), "disablers"))),
    ))
    fitting = own.filter("compatibility is not null").groupBy("child").agg(F.count_distinct("compatibility").alias("n")).filter("n > 1").select(F.col("child").alias("cluster"), F.lit("merge:compatibility-joined").alias("rule_id"), F.lit(None).cast("string").alias("severity"), F.lit("from more than one source").alias("message"))
    differing = reconcile_metadata(own.select("child", "source_order", F.explode("metadata").alias("key", "value"))).filter("differs")
    notes = differing.select(F.col("child").alias("cluster"), F.lit("merge:metadata-differs").alias("rule_id"), F.lit(None).cast("string").alias("severity"), F.concat(F.lit("kept the first source's "), "key").alias("message"))
    return fields.select(F.col("child").alias("cluster"), F.explode(found).alias("f")).select("cluster", "f.*").unionByName(fitting).unionByName(notes)
