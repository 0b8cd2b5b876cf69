"""Column functions over text: tokens, keys, slugs, lines."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no signal when entries are ranked.
STOP_WORDS = [
    "a", "against", "an", "and", "are", "but", "can", "for", "from", "get", "has", "have", "how", "into", "its", "make",
    "need", "needs", "new", "not", "off", "one", "our", "out", "over", "run", "that", "the", "their", "them", "then", "this",
    "use", "used", "uses", "using", "want", "what", "when", "with", "work", "you", "your",
]
# Code words that programming entries share; left out when queries are routed.
ROUTING_STOP_WORDS = [
    "code", "codes", "coding", "program", "programs", "programming", "python", "script", "scripts", "scripting",
    "write", "writes", "writing", "written",
]
# Words that say nothing about a directive's subject.
SUBJECT_STOP_WORDS = ["always", "never", "must", "should", "do", "not", "dont", "avoid", "use", "the", "a", "an"]
# Words that alone don't name a task.
VAGUE_WORDS = [
    "help", "stuff", "things", "thing", "something", "anything", "skills", "skill", "do", "some", "get", "make", "want",
    "need", "please", "the", "a", "an", "for", "with", "and", "me", "my",
]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: str | Column) -> Column:
    """Distinct tokens in order of first place: runs of [a-z0-9.+#-] of the lower-cased text without dots and dashes at their
    ends; stop words and short tokens go, unless they hold # or +."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("([a-z0-9.+#-]+)"), 1)
    trimmed = F.transform(found, lambda x: F.btrim(x, F.lit(".-")))
    return F.array_distinct(F.filter(trimmed, lambda x: ~x.isin(STOP_WORDS) & ((F.length(x) >= 3) | x.contains("#") | x.contains("+"))))


def routing_tokens(text: str | Column) -> Column:
    return F.array_except(tokenize(text), F.array(*map(F.lit, ROUTING_STOP_WORDS)))


def relevance_tokens(text: str | Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= 3))


def subject_words(text: str | Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(SUBJECT_STOP_WORDS)))


def clean(value: str | Column) -> Column:
    return F.lower(F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", ""))


#: Beyond the first 256 characters, which are composed already and fold as they lower but for sharp s and micro, or white space that
#: only Python knows. Other spellings of this take Java's matcher over ten times as long, as one class of several ranges does.
_OTHER = r"[^\x00-\x1B\x20-\xFF]|[\x85\xA0]"


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    # by slices: few texts of a batch are Python's strings at a time
    parts = [pa.array([None if t is None else " ".join(unicodedata.normalize("NFC", t).split()).casefold() for t in texts.slice(i, 64).to_pylist()], texts.type) for i in range(0, len(texts), 64)]
    return pa.concat_arrays(parts) if parts else texts


def folded(text: str | Column) -> Column:
    """norm_key without dropping marks at the end: what a text is within a longer one. Texts of Latin-1 characters stay in the JVM."""
    text = _col(text)
    other = text.rlike(_OTHER)
    lowered = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    plain = F.replace(F.replace(lowered, F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    return F.when(other, _folded(F.when(other, text))).otherwise(plain)


def without_end_marks(key: str | Column) -> Column:
    return F.rtrim(F.rtrim(_col(key), F.lit(".:;")))


def norm_key(text: str | Column) -> Column:
    """Key of exact duplicates: composed (NFC), trimmed, white space collapsed, case folded, marks .:; at the end dropped.

    Equals `norm_key_full`. Texts of Latin-1 characters stay in the JVM, where little but lower-casing folds them and no composing
    is needed; Python gets the others.
    """
    return without_end_marks(folded(text))


def norm_key_full(text: str | Column) -> Column:
    return without_end_marks(_folded(_col(text)))


def slug(label: str | Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(_col(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(made, 1, 64), F.lit("")), F.lit("skill"))


def short_hash(text: str | Column) -> Column:
    return F.substring(F.sha2(_col(text).cast("binary"), 256), 1, 16)


def atom_id(owner: str | Column, path: str | Column, text: str | Column) -> Column:
    return F.concat_ws(":", _col(owner), _col(path), short_hash(text))


#: Ends of lines: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, and the separators of lines and paragraphs.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


RARER_END = r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line, numbered from 1; an empty last line doesn't count. Other columns are kept."""
    others = [c for c in df.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    # most texts have no other ends than LF, at which they are split without a pattern
    parts = F.when(whole.rlike(RARER_END), F.split(whole, LINE_END)).otherwise(F.split(whole, "\n"))
    # a variable of a function: the text is split once
    lines = F.get(F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)), F.lit(0))
    rows = df.select(*others, lines.alias("__lines"))
    return rows.select(*others, F.posexplode("__lines").alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def intake(df: DataFrame, text: str) -> DataFrame:
    """df with use_case, word_count, thin and reasons: whether a description is too thin to work from."""
    use_case = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    words = F.regexp_extract_all(F.lower(use_case), F.lit("([a-z0-9]+)"), 1)
    concrete = F.exists(words, lambda w: ~w.isin(VAGUE_WORDS))
    reasons = F.array_compact(F.array(F.when(F.size(words) < 4, F.lit("too short to infer a use case")), F.when(~concrete, F.lit("no concrete task named"))))
    return df.withColumns({"use_case": use_case, "word_count": F.size(words), "thin": F.size(reasons) > 0, "reasons": reasons})
