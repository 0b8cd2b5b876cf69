"""Quality rules: text statistics and a learned decision list, as DataFrame expressions only.

Sequential covering grows one rule at a time for the rejected class: a conjunction of thresholds on text statistics is
extended while a grow set shows information gain, then pruned from its end on a separate prune set, and the rows it covers
are set aside before the next rule. The list becomes one ordered conditional expression. Every step looks only at counts by
(statistic, bin), which Spark aggregates; the driver sees a table of statistics x bins, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import SPACES, fit_sample, fold, saved, table

#: Statistics that conditions may test; each is a ratio or a count that `text_statistics` derives.
STATISTICS = ["symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "pipe_rate", "digit_rate", "punct_rate", "mean_word", "distinct_rate", "line_words"]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the base counts and the ratios in STATISTICS; a null text counts as empty.

    Windows of three words are compared by 64-bit hash within their own text. A text without words has every count 0 and
    every ratio 0. Columns of df that have the names of statistics are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *STATISTICS]
    kept = [c for c in df.columns if c != text and c not in made]
    spaces = "".join(SPACES)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = df.select(*[f"`{c}`" for c in kept], t.alias("__t"), F.array_remove(F.split(F.translate(t, spaces, " " * len(spaces)), " "), "").alias("__w"))
    blank = F.translate(F.lit(""), "", "")
    hashed = base.select(
        *[f"`{c}`" for c in kept],
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        (F.length("__t") - _count(F.col("__t"), spaces)).cast("long").alias("word_chars"),
        _count(F.col("__t"), "#*$%&|<>").cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: F.translate(x, spaces, "") != blank).alias("__l"),
        _count(F.col("__t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("__upper"),
        _count(F.col("__t"), "!").alias("__bang"),
        _count(F.col("__t"), "|").alias("__pipe"),
        _count(F.col("__t"), "0123456789").alias("__digit"),
        _count(F.col("__t"), ".,;:?").alias("__punct"),
        F.when(F.size("__w") >= 3, F.expr("transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2]))")).otherwise(F.expr("cast(array() as array<bigint>)")).alias("__h"),
    )
    marked = hashed.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).withColumn(
        "__s",  # hashes with their places, in order, but only where one of them comes back
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.expr("transform(__h, (h, i) -> struct(h as h, i as i))"))),
    )
    twice = "filter(__s, (x, j) -> (j > 0 and __s[j - 1].h = x.h) or (j < size(__s) - 1 and __s[j + 1].h = x.h))"
    placed = marked.withColumn("__p", F.expr(f"sort_array(transform({twice}, x -> x.i))"))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    words, chars = F.col("n_words"), F.col("word_chars")
    return (
        placed.withColumn(  # each place covers three words, less what the place before it covers
            "n_repeat_words",
            F.coalesce(F.expr("aggregate(__p, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)"), F.lit(0)).cast("long"),
        )
        .withColumns(
            {
                "symbol_rate": rate(F.col("n_symbols"), chars),
                "dup_line_rate": rate(F.col("n_dup_lines"), F.size("__l")),
                "repeat_rate": rate(F.col("n_repeat_words"), words),
                "upper_rate": rate(F.col("__upper"), chars),
                "bang_rate": rate(F.col("__bang"), words),
                "pipe_rate": rate(F.col("__pipe"), words),
                "digit_rate": rate(F.col("__digit"), chars),
                "punct_rate": rate(F.col("__punct"), words),
                "mean_word": rate(chars, words),
                "distinct_rate": rate(F.size(F.array_distinct("__w")), words),
                "line_words": rate(words, F.size("__l")),
            }
        )
        .select(*[f"`{c}`" for c in kept], *made)
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Rule:
    """Rejects rows that meet all conditions (statistic, ">" or "<=", threshold)."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) > t if op == ">" else F.col(s) <= t for s, op, t in self.conditions], F.lit(True))


@dataclass
class DecisionList:
    rules: list[Rule]

    def kept(self) -> Column:
        """Ordered conditional expression: the first rule that applies rejects; none keeps."""
        out = None
        for rule in self.rules:
            out = (F if out is None else out).when(rule.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def fired(self) -> Column:
        out = None
        for i, rule in enumerate(self.rules):
            out = (F if out is None else out).when(rule.column(), F.lit(i))
        return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def learn_decision_list(rows: DataFrame, label: str, statistics: list[str] = STATISTICS, bins: int = 40, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.97, min_rows: int = 5) -> DecisionList:
    """Rules for label 0 (reject) from rows with statistics and a 0/1 label; rows without a label are left out.

    rows needs a column `__grow` (true: grow set, false: prune set). With no rows, or rows of one class only, the list is
    empty and keeps everything. Ties between conditions go to the first statistic and threshold.
    """
    rows = rows.filter(F.col(label).isNotNull()).withColumn("__pos", (F.col(label) == 0).cast("long"))
    grid = [i / bins for i in range(1, bins)] + [0.99, 0.995]
    found = rows.agg(*[F.percentile_approx(s, grid, 2000).alias(s) for s in statistics], *[F.percentile_approx(F.when(F.col("__pos") == 1, F.col(s)), grid, 2000).alias(f"p_{s}") for s in statistics]).first()
    cuts = {s: sorted({x for x in (found[s] or []) + (found[f"p_{s}"] or [])}) for s in statistics}
    if not any(cuts.values()):
        return DecisionList([])

    def bin_of(s: str) -> Column:
        value = F.col(s)
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[s]]), lambda c: value > c)) if cuts[s] else F.lit(0)

    binned = rows.select(
        "__grow", "__pos", *statistics,
        F.array(*[bin_of(s) for s in statistics]).alias("__bins"),
    )
    binned = saved(binned, "binned")

    def tally(left: DataFrame) -> dict[int, dict[int, tuple[int, int]]]:
        got = left.select(F.posexplode("__bins").alias("s", "b"), "__pos").groupBy("s", "b").agg(F.sum("__pos").alias("p"), F.count("*").alias("n")).collect()
        out: dict[int, dict[int, tuple[int, int]]] = {}
        for r in got:
            out.setdefault(r["s"], {})[r["b"]] = (r["p"], r["n"] - r["p"])
        return out

    def best(counts: dict) -> tuple[float, tuple[str, str, float]] | None:
        p0, n0 = (sum(x) for x in zip(*counts.get(0, {0: (0, 0)}).values()))
        if not p0 or not n0:
            return None
        log0, top = math.log2(p0 / (p0 + n0)), None
        for i, s in enumerate(statistics):
            found_by: dict[str, list[tuple[float, float]]] = {"<=": [], ">": []}
            below_p = below_n = 0
            for k, c in enumerate(cuts[s]):
                p, n = counts[i].get(k, (0, 0))
                below_p, below_n = below_p + p, below_n + n
                for op, q, m in (("<=", below_p, below_n), (">", p0 - below_p, n0 - below_n)):
                    if q >= min_rows:
                        found_by[op].append((q * (math.log2(q / (q + m)) - log0), c))
            for op, tried in found_by.items():
                gain = max((g for g, _ in tried), default=0.0)
                if gain > (top[0] if top else 1e-9):
                    tied = [c for g, c in tried if g == gain]
                    top = (gain, (s, op, (tied[0] + tied[-1]) / 2))
        return top

    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        rule = Rule()
        while len(rule.conditions) < max_conditions:
            step = best(tally(left.filter(F.col("__grow") & rule.column())))
            if step is None:
                break
            name, op, cut = step[1]
            near = left.filter(F.col("__grow") & rule.column()).agg(F.max(F.when(F.col(name) <= cut, F.col(name))), F.min(F.when(F.col(name) > cut, F.col(name)))).first()
            if near[0] is not None and near[1] is not None:
                cut = (near[0] + near[1]) / 2  # the middle of the gap between the values on either side
            rule.conditions.append((name, op, cut))
        if not rule.conditions:
            break
        prefixes = [Rule(rule.conditions[:k]).column() for k in range(1, len(rule.conditions) + 1)]
        row = left.filter(~F.col("__grow")).agg(*[F.sum((x & (F.col("__pos") == v)).cast("long")).alias(f"c{k}_{v}") for k, x in enumerate(prefixes) for v in (0, 1)]).first()
        worth = []
        for k in range(len(prefixes)):
            n, p = row[f"c{k}_0"] or 0, row[f"c{k}_1"] or 0
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        value, k, p, n = max(worth)
        if p < 1 or p / (p + n) < min_precision:
            break
        rule = Rule(rule.conditions[: 1 - k])
        rules.append(rule)
        left = left.filter(~rule.column())
    return DecisionList(rules)


def labelled_statistics(stats: DataFrame, labels: DataFrame, label: str, max_fit_rows: int) -> DataFrame:
    """Fit rows: labelled, not held out, at most about max_fit_rows of them by a hash of the id (a documented bound).

    Null labels are left out, as are labels of unknown and null ids; a doc_id with several labels stands once for each.
    """
    rows = stats.filter(~F.col("base_failed") & (fold(F.col("doc_id")) != 2)).join(labels.select("doc_id", label).filter(F.col(label).isNotNull()), "doc_id")
    n = labels.count()
    share = min(1.0, max_fit_rows / max(1, n))
    key = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20))
    return rows.filter(key < int(share * (1 << 20))).withColumn("__grow", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)) < 2)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit_rows: int = 200_000) -> DataFrame:
    """doc_id with the base counts, base_failed and kept; docs needs doc_id and text.

    Null or empty texts have no words and fail the base. Repeated rows are judged one by one and alike. Labels whose doc_id
    is null or unknown are not used. A document with several label rows is fitted once for each.
    """
    stats = text_statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    stats = saved(stats, "statistics")
    rules = learn_decision_list(labelled_statistics(stats, labels, label, max_fit_rows), label)
    return stats.withColumn("rule", rules.fired()).withColumn("kept", ~F.col("base_failed") & rules.kept())


def keep_by_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit_rows: int = 200_000) -> DataFrame:
    """docs less the rows that fail the base or that a learned rule rejects, with their columns as they are.

    Rules are learned from the statistics of labelled rows alone (a bounded sample, without held-out ones); then all rows are
    judged in one pass, without a shuffle of texts. Nulls, repeated rows and labels are treated as in apply_quality_rules.
    """
    sample = text_statistics(fit_sample(docs.select("doc_id", "text"), labels, label, max_fit_rows).select("doc_id", F.col("label").alias("__label"), "text"))
    grow = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)) < 2
    sample = saved(sample, "labelled").filter(~base_failed()).withColumn("__grow", grow)
    rules = learn_decision_list(sample, "__label")
    judged = text_statistics(docs.select(F.struct("*").alias("__row"), "text"))
    # a condition that isn't deterministic stays above the statistics; pushed below, it would work them out over and over
    judged = judged.withColumn("__place", F.monotonically_increasing_id())
    return judged.filter((F.col("__place") >= 0) & ~base_failed() & rules.kept()).select("__row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts and verdict; null and empty texts fail the base, an empty table gives no rows."""
    out = apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
