"""Mixing sources to target weights by systematic sampling.

A source's documents all have the same expected number of copies: its target over its size. These are prefix-summed over the
documents in the order of their sizes, one random offset is added, and a document is taken once for each integer that its
stretch of the sum crosses. Documents of like size stand together, so that what rounding takes from one its neighbour gets
back: a source's taken words miss the target by no more than about one long document. Sums are whole numbers of 2**-24 copies,
so that neither their order nor rounding changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import free_name, partitions, saved, small, table

#: Parts of a copy.
UNIT = 1 << 24


def with_rank(df: DataFrame, within: list[str], order: list[Column], name: str) -> DataFrame:
    """df with `name`: the place from 0 among rows with the same `within`, in the given order.

    Rows are dealt into ranges of the order and counted by range, so that no task has all rows of a hot group; nulls are
    ordinary values of `within` and come last. Rows equal in all of `order` stand in any order.
    """
    part, last, n, base, keys = (free_name(x, df.columns) for x in ("__part", "__last", "__n", "__base", "__keys"))
    nulls_last = [c for w in within for c in (F.col(w).isNull(), F.col(w))]
    ranged = saved(df.repartitionByRange(partitions(df.sparkSession), *nulls_last, *order).withColumn(part, F.spark_partition_id()), "ranged")
    marks = [free_name(f"{w}__k", df.columns) for w in within]
    counts = ranged.groupBy(part, *within).agg(F.count("*").alias(n))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(part).alias(last), *(F.col(w).alias(m) for w, m in zip(within, marks)), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    same = F.col(part) == F.col(last)
    for w, m in zip(within, marks):
        same = same & F.col(w).eqNullSafe(F.col(m))
    own = F.row_number().over(Window.partitionBy(part, *within).orderBy(*order)) - 1
    return ranged.withColumn(n, own).join(bases, same).withColumn(name, F.col(n) + F.col(base)).drop(part, last, n, base, *marks)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size and target for each row of sizes (source, source_size).

    Sources in code-point order, null last, weigh `weights`, repeating, and share `share` (at most `most`) times all sizes. No
    target is above `most` times its source's size: what exceeds that is shared again by weight among the others, until none is
    above. The words for one unit of weight only grow from round to round, so few rounds are needed; three sums a round reach
    the driver. No sources: no rows.
    """
    ranked = with_rank(sizes.select("source", "source_size"), [], [F.col("source").isNull(), F.col("source")], "__rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.select("source", F.col("source_size").cast("long").alias("source_size"), weight.cast("double").alias("weight")), "sources")
    cap = most * F.col("source_size").cast("double")
    words, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    left, weight_left, n_capped = share * (words or 0), all_weights or 1.0, 0
    while True:
        fair = F.col("weight") * F.lit(float(left)) / F.lit(float(weight_left))
        above = fair > cap
        n, held, weighed = ranked.filter(above).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if n == n_capped or weighed == all_weights:
            return ranked.select("source", "source_size", F.least(fair, cap).alias("target"))
        left, weight_left, n_capped = share * words - held, all_weights - weighed, n


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 13) -> DataFrame:
    """docs with size, source_size, target (its source's) and copies (0 to `most`); explode(sequence(1, copies)) writes the mix.

    docs needs doc_id and source. A null source is a source of its own, the last one. The offset is drawn from the seed and the
    source, and rows of one size are put in order by a hash of the id and of the whole row, so reruns agree, however the table
    is partitioned; equal rows are taken one by one. Columns of docs with the names of new ones are replaced. A source without
    words has target 0 and no copies. No documents: no rows.
    """
    rows = saved(docs.drop("source_size", "target", "copies").withColumn("size", F.coalesce(size, F.lit(0)).cast("long")), "sized")
    sums = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    targets = source_targets(sums, weights, share, most)
    step, offset, key, rank = (free_name(n, rows.columns) for n in ("__step", "__offset", "__source", "__rank"))
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 6)
    per_copy = F.coalesce(F.floor(F.try_divide("target", "source_size") * UNIT + 0.5), F.lit(0)).cast("long")
    known = saved(targets.select(F.col("source").alias(key), "source_size", "target", per_copy.alias(step), F.conv(hexed, 16, 10).cast("long").alias(offset)), "targets")
    n_bytes = known.agg(F.sum(F.coalesce(F.octet_length(key), F.lit(0)) + 80)).first()[0] or 0
    order = [F.col("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.xxhash64(*rows.columns)]
    placed = with_rank(rows, ["source"], order, rank).join(small(known, n_bytes), F.col("source").eqNullSafe(F.col(key)))
    upto = lambda n: F.shiftright(F.col(offset) + F.col(step) * n, 24)
    return placed.withColumn("copies", (upto(F.col(rank) + 1) - upto(F.col(rank))).cast("int")).drop(step, offset, key, rank)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents with words as sizes; taken is the words of all copies of a row."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("size"))
    mixed = mix(sized, F.col("size"))
    return mixed.select("doc_id", "size", F.col("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
