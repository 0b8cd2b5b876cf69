"""Divergence of sources within a language, by two-dimensional tiling of group blocks.

Each (language, source) group has a count of each kept term of its language. Terms are dealt into chunks, and a group's counts in
a chunk are packed into one row. Groups are dealt into blocks; a task has a pair of blocks and a stripe of chunks, to which the
packed rows are replicated, and adds up its submatrix of pairs chunk after chunk, so that it holds two blocks' shares of one
chunk at a time. What no group of a tile counts isn't sent there: all its terms differ alike, by what a count of 0 gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_task, partitions, saved, table
from corpusforge.llm.terms import counted, letters_or_beyond_ascii, runs
from corpusforge.llm.tokens import slices

SCALE = 1_000_000_000
SMOOTHING = 5


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with the term); null text, lang and source are empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text"), 3 << 20):
                part = batch.slice(lo, hi - lo)
                found, doc = runs(part.column("text"), letters_or_beyond_ascii)
                row, code, n = counted(found.indices.to_numpy(), doc, len(found.dictionary))
                groups = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
                names: dict[tuple, int] = {}
                of = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in groups.to_pylist()], np.int64)
                order = np.lexsort((code, of[row]))
                group, code, n = of[row][order], code[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (code[1:] != code[:-1])])) if len(group) else group
                langs, sources = (pa.array([k[i] for k in names], pa.string()).take(pa.array(group[first])) for i in (0, 1))
                sums = np.add.reduceat(n, first) if len(first) else n
                yield pa.RecordBatch.from_arrays([langs, sources, found.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array(sums.astype(np.int64)), pa.array(np.diff(np.append(first, len(group))).astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = rows.mapInArrow(arrow_task(count), "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int | np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * n_terms)) without rounding, by long division in three steps; exact while the divisor is below 9 * 10**15."""
    divisor = total + SMOOTHING * n_terms
    left, out = counts + SMOOTHING, 0
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // divisor
        left = left % divisor
    return out + 1


def _share(count: Column, total: Column, n_terms: Column) -> Column:
    """The same as a column, in whole numbers of 38 digits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)"), (total + SMOOTHING * n_terms).cast("decimal(20,0)")) + 1


def pair_sums(groups: DataFrame, packed: DataFrame, block: int, stripe: int) -> DataFrame:
    """lang, source, other and value: the sum over all kept terms of the difference of shares, each unordered pair once.

    groups: lang, source, total, n_terms, n_blocks, n_stripes, block; packed: lang, source, chunk, size, at, n.
    """
    keys = ["lang", "tile_a", "tile_b", "stripe"]

    def replicated(rows: DataFrame) -> DataFrame:
        """A row for each tile of its block: with every block, the smaller one first."""
        to = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        return to.withColumn("tile_a", F.least("block", "__b")).withColumn("tile_b", F.greatest("block", "__b"))

    heads = replicated(groups.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("n_stripes") - 1)))).select(
        *keys, F.lit(-1).alias("chunk"), "source", "block", "total", "n_terms", F.lit(0).alias("size"), F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<bigint>").alias("n")
    )
    placed = packed.join(groups.select("lang", "source", "block", "n_blocks", "n_stripes"), ["lang", "source"])
    bodies = replicated(placed.withColumn("stripe", F.floor(F.col("chunk") / stripe).cast("int"))).select(
        *keys, "chunk", "source", "block", F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("n_terms"), "size", "at", "n"
    )
    rows = heads.unionByName(bodies).repartition(partitions(groups.sparkSession), *keys).sortWithinPartitions(*keys, "chunk")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: Tile | None = None
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if tile is None or tile.key != key:
                    if tile is not None:
                        yield tile.result()
                    tile = Tile(key)
                tile.take(r)
        if tile is not None:
            yield tile.result()

    parts = rows.mapInArrow(arrow_task(add_up), "lang string, source string, other string, part bigint, rest bigint, base bigint, n_terms bigint")
    # terms in chunks that no group of the tile counts: what a count of 0 gives, for each
    return parts.groupBy("lang", "source", "other").agg((F.sum("part") + F.first("base") * (F.first("n_terms") - F.sum("rest"))).alias("value"))


class Tile:
    """Two blocks of groups over the chunks of a stripe, which come one after another."""

    def __init__(self, key: tuple):
        self.key = key
        self.sides: tuple[list[dict], list[dict]] = ([], [])
        self.chunk, self.size, self.rows, self.covered = -1, 0, [], 0
        self.sums: np.ndarray | None = None

    def take(self, r: dict) -> None:
        if r["chunk"] < 0:
            for side, block in enumerate(self.key[1:3]):
                if r["block"] == block:
                    self.sides[side].append(r)
            return
        if r["chunk"] != self.chunk:
            self._close()
            self.chunk, self.size = r["chunk"], r["size"]
        self.rows.append(r)

    def _close(self) -> None:
        """Add the chunk that is held to the sums."""
        if self.sums is None:
            self.sums = np.zeros((len(self.sides[0]), len(self.sides[1])), np.int64)
            self.place = [{g["source"]: i for i, g in enumerate(side)} for side in self.sides]
            self.n_terms = max((g["n_terms"] for side in self.sides for g in side), default=0)  # the same in all of a language
        if not self.rows:
            return
        found = []
        for side in range(2 if self.key[1] != self.key[2] else 1):
            counts = np.zeros((len(self.sides[side]), self.size), np.int64)
            for r in self.rows:
                if r["source"] in self.place[side]:
                    counts[self.place[side][r["source"]], r["at"]] = r["n"]
            totals = np.array([g["total"] for g in self.sides[side]], np.int64)[:, None]
            found.append(shares(counts, totals, self.n_terms))
        a, b = found[0], found[-1]
        for i in range(len(a)):
            self.sums[i] += np.abs(b - a[i]).sum(1)
        self.covered += self.size
        self.rows = []

    def result(self) -> pa.RecordBatch:
        self._close()
        same = self.key[1] == self.key[2]
        a, b = self.sides
        pairs = [(i, j) for i in range(len(a)) for j in range(i + 1 if same else 0, len(b))]
        zero = [[int(shares(np.zeros(1, np.int64), g["total"], g["n_terms"])[0]) if g["n_terms"] else 0 for g in side] for side in self.sides]
        columns = [
            pa.array([self.key[0]] * len(pairs), pa.string()), pa.array([a[i]["source"] for i, _ in pairs], pa.string()), pa.array([b[j]["source"] for _, j in pairs], pa.string()),
            pa.array([int(self.sums[i, j]) for i, j in pairs], pa.int64()), pa.array([self.covered] * len(pairs), pa.int64()), pa.array([abs(zero[0][i] - zero[1][j]) for i, j in pairs], pa.int64()), pa.array([a[i]["n_terms"] for i, _ in pairs], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "other", "part", "rest", "base", "n_terms"])


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, block: int = 32, chunk: int = 2048, stripe: int = 8) -> DataFrame:
    """lang, source, part, item, value, rank for each (lang, source) group: `pair` rows against each other source of its
    language, `term` rows for the top terms that stand out against the whole language.

    docs needs text, lang and source; nulls in them are empty, so a null source and an empty one are one group. A language keeps
    the terms in at least min_docs of its rows; one without such terms has pairs of value 0 and no term rows, and a source alone
    in its language has no pairs. Repeated rows count as often as they stand. No documents: no rows.
    """
    counts = saved(term_counts(docs), "counts")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    terms = saved(by_lang, "terms")
    langs = saved(terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total")), "langs")
    n_chunks = F.ceil(F.col("n_terms") / chunk).cast("int")
    placed = terms.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), n_chunks).cast("int"))
    in_chunk = Window.partitionBy("lang", "chunk")
    placed = placed.withColumn("at", F.row_number().over(in_chunk.orderBy("term")) - 1).withColumn("size", F.count("*").over(in_chunk).cast("int"))
    kept = saved(counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    n_groups = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
    sides = (
        groups.join(totals, ["lang", "source"], "left").join(n_groups, "lang").join(langs.select("lang", "n_terms"), "lang", "left").fillna(0, ["total", "n_terms"])
        .withColumn("n_blocks", F.ceil(F.col("n_groups") / block).cast("int")).withColumn("n_stripes", F.greatest(F.lit(1), F.ceil(n_chunks / stripe)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int"))
    )
    sides = saved(sides, "groups")
    packed = kept.groupBy("lang", "source", "chunk").agg(F.max("size").alias("size"), F.collect_list(F.struct("at", "n")).alias("x")).select("lang", "source", "chunk", "size", F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    once = saved(pair_sums(sides, packed, block, stripe), "pairs")
    both = once.union(once.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    own = kept.join(sides.select("lang", "source", "total"), ["lang", "source"])
    value = (_share(F.col("n"), F.col("total"), F.col("n_terms")) - _share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))).cast("long")
    standing_out = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(standing_out.withColumn("rank", rank).filter(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language over all documents."""
    return divergence(table(spark, sf_dir, "documents"))
