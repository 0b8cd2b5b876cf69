"""Held-out texts in one corpus: all bodies joined in their order, so that what runs from one into the next is found too.

The corpus is never joined in one place. Each text's place in the whole is a running total of lengths; the whole is cut there
into blocks that overlap by the longest needle, and a task runs an automaton of all needles over a block, piece after piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import folded, norm_key, without_end_marks
from corpusforge.sources.tables import saved

#: Characters of needles in one automaton (about 40 bytes each), and of the corpus in a block.
NEEDLES, BLOCK = 1 << 20, 1 << 20


def running_total(df: DataFrame, order: list[str], value: str, name: str, ranges: int) -> DataFrame:
    """df with name: the sum of value over all rows before, in the given order. Rows are dealt into ranges of the order and summed
    by range, so no task has all of them."""
    ranged = saved(df.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = lambda keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))  # a row for each range
    bases = sums.select("__part", F.coalesce(F.sum("__sum").over(before([F.lit(0)]).orderBy("__part")), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(value).over(before(["__part"]).orderBy(*order)), F.lit(0))
    return ranged.withColumn("__inside", inside).join(bases, "__part").withColumn(name, F.col("__base") + F.col("__inside")).drop("__part", "__inside", "__base")


def _joined(corpus: DataFrame) -> DataFrame:
    """position and text of each part of the corpus (doc, text), in the order of doc, each part closed by a space.

    Parts without a character but white space give nothing, as white space is collapsed; the last part loses its end marks.
    """
    # the filter comes after the writing: before it, the key would be made twice, in two of Python's processes a task
    parts = saved(corpus.select(F.col("doc").alias("position"), folded("text").alias("text")), "parts").filter("text != ''")
    last = parts.agg(F.max("position")).first()[0]
    return parts.select("position", F.concat(F.when(F.col("position") == F.lit(last), without_end_marks("text")).otherwise(F.col("text")), F.lit(" ")).alias("text"))


def leaks(items: DataFrame, corpus: DataFrame, least: int = 8) -> DataFrame:
    """item_id of items (item_id, text) whose key of `least` characters or more stands in the corpus (doc, text).

    The corpus is the texts' folded forms in the order of doc (distinct, without nulls), a space between each two: a passage
    that ends in one text and begins in the one before is a leak. Needles are searched for in groups of about a million
    characters; each group is one pass over the written pieces. Null texts hold nothing and are in nothing.
    """
    spark = items.sparkSession
    keyed = saved(items.select("item_id", norm_key("text").alias("needle")), "needles").filter(F.length("needle") >= least)
    n_chars, longest = keyed.agg(F.sum(F.length("needle")), F.max(F.length("needle"))).first()
    if not n_chars:
        return keyed.select("item_id")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(BLOCK, 4 * longest)
    placed = running_total(_joined(corpus).withColumn("n", F.length("text").cast("long")), ["position"], "n", "start", ranges)
    ahead = longest - 1  # a block reads on so far, to end what begins in it
    first, final = F.floor((F.col("start") - ahead) / block), F.floor((F.col("start") + F.col("n") - 1) / block)
    cut = placed.select("*", F.explode(F.sequence(F.greatest(first, F.lit(0)), final)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * block + ahead)
    pieces = cut.select("block", low.alias("at"), F.substring("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("text")).filter("text != ''")
    pieces = saved(pieces.repartition(ranges, "block").sortWithinPartitions("block", "at"), "pieces")
    n_groups = -(-n_chars // NEEDLES)
    found = None
    for g in range(n_groups):
        group = [r[0] for r in keyed.filter(F.pmod(F.xxhash64("needle"), F.lit(n_groups)) == g).select("needle").distinct().collect()]
        hits = pieces.mapInArrow(_searcher(group), "needle string").distinct()
        found = hits if found is None else found.union(hits)
    return keyed.join(found, "needle").select("item_id").distinct()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """block and text of one row after another: one text at a time is Python's, and no batch is kept while the next is read."""
    for batch in batches:
        blocks, texts = batch.column("block"), batch.column("text")
        for i in range(batch.num_rows):
            yield blocks[i].as_py(), texts[i].as_py()
        del batch, blocks, texts


def _searcher(needles: list[str]):
    """Needles found in pieces of blocks; the automaton's state goes on from piece to piece of a block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, needle in enumerate(needles):
            automaton.add_word(needle, i)
        if not len(automaton):
            return
        automaton.make_automaton()
        found: set[int] = set()
        block, state = None, automaton.iter("")
        for b, text in _rows(batches):
            state.set(text, b != block)
            block = b
            found.update(i for _, i in state)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
        yield pa.RecordBatch.from_arrays([pa.array([needles[i] for i in found], pa.string())], ["needle"])

    return search
