"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in the partitions that the table is read in. Where a uniformly shuffled table is cut into shards of given sizes, the
number of rows that go from partition p to shard s follows a multivariate hypergeometric law. The matrix of these counts is
drawn first, from the counts of partitions alone; then each partition permutes its rows and deals them out by its row of the
matrix, the rows are exchanged, and each shard permutes what it got. Rows are numbered once, in a written table, and permuted by
a hash of the number, so that equal rows go apart. All row work is DataFrame windows; only the counts reach the driver.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import free_name, saved, small, table


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """Good ones among n balls drawn without replacement; exact inversion, enumerating outcomes from the mode outwards.
    Of no balls, or where none is drawn, it is 0."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    log = math.lgamma
    p = math.exp(log(good + 1) - log(mode + 1) - log(good - mode + 1) + log(bad + 1) - log(n - mode + 1) - log(bad - n + mode + 1) - log(good + bad + 1) + log(n + 1) + log(good + bad - n + 1))
    u, total = rng.random(), p
    up, down, p_up, p_down = mode, mode, p, p
    while total < u and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up, total = up + 1, total + p_up
            if total >= u:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down, total = down - 1, total + p_down
            if total >= u:
                return down
    return mode


def communication_matrix(counts: list[int], capacities: list[int], rng: random.Random) -> list[list[int]]:
    """Rows: blocks; columns: shards. Row sums are counts, column sums are capacities."""
    left, out = list(capacities), []
    for n in counts:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            k = hypergeometric(rng, room, rest - room, n) if n else 0
            rest -= room
            n -= k
            left[s] -= k
            row.append(k)
        out.append(row)
    return out


def shard_rows(df: DataFrame, n_shards: int, seed: int = 17, rows_a_part: int = 20_000) -> DataFrame:
    """df with `shard` (0 to n_shards - 1, counts at most one apart) and `slot` (gapless from 0 within the shard).

    Nulls in any column are ordinary values and equal rows are dealt one by one. An empty table gives an empty result. Columns
    of df that are named shard or slot are replaced. A shard is put in order in parts of about rows_a_part rows.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    row, source, rank, cuts, part, base = (free_name(n, df.columns) for n in ("__row", "__source", "__rank", "__cuts", "__part", "__base"))
    rows = saved(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hashed = lambda salt: F.xxhash64(F.col(row), F.lit(seed * 2 + salt))
    from_part = F.shiftright(F.col(row), 33).cast("int")  # the partition, as monotonically_increasing_id numbers rows
    counts = sorted((r[0], r[1]) for r in rows.groupBy(from_part.alias("p")).count().collect())
    n_rows = sum(n for _, n in counts)
    capacities = [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], capacities, random.Random(seed))
    ends = [(p, list(itertools.accumulate(m))) for (p, _), m in zip(counts, matrix)]
    dealing = spark.createDataFrame(ends, f"{source} int, {cuts} array<bigint>")
    dealt = (
        rows.withColumn(source, from_part)
        .withColumn(rank, F.row_number().over(Window.partitionBy(source).orderBy(hashed(0), row)) - 1)
        .join(small(dealing, len(counts) * (n_shards + 4) * 8), source)
        .withColumn("shard", F.expr(f"size(filter({cuts}, c -> c <= {rank}))"))
        .drop(source, rank, cuts)
    )
    n_parts = max(1, n_rows // (n_shards * rows_a_part))
    dealt = saved(dealt.withColumn(part, F.pmod(hashed(1), F.lit(n_parts)).cast("int")), "dealt")
    ordered = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", part).agg(F.count("*").alias("n")).select("shard", part, F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias(base))
    return (
        dealt.withColumn(rank, F.row_number().over(Window.partitionBy("shard", part).orderBy(hashed(1), row)) - 1)
        .join(small(bases, (n_parts + 1) * n_shards * 24), ["shard", part])
        .withColumn("slot", F.col(base) + F.col(rank))
        .drop(part, rank, base, row)
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`; size is the text's UTF-8 bytes plus 1, a null text has none."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    rows = shard_rows(docs, 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
