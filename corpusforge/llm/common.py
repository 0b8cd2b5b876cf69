"""Helpers shared by the training-data operators: inputs, scratch tables, folds and vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: a word is a maximal run of anything else.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local one, but only if all runs in one process: on a
    cluster executors would write elsewhere than others read."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark.sparkContext, "_corpusforge_dir", None)
        if path is None:
            path = spark.sparkContext._corpusforge_dir = "file://" + tempfile.mkdtemp(prefix="corpusforge-")
    return path.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusforge/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; for when its results are written, as they may still read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    tidy()  # between steps, for the driver
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver find what nothing refers to any more, so that executors delete shuffle files of finished steps."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, n_bytes: int, limit: int = 4 << 20) -> DataFrame:
    """Broadcast a side whose size has been computed to be under limit; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if n_bytes < limit else df


def matched(rows: DataFrame, keys: DataFrame, n_keys: int, column: str, how: str, most: int = 2_000_000) -> DataFrame:
    """rows joined (inner, left_semi or left_anti) with keys, whole numbers in column, without moving rows: keys are broadcast.
    More than `most` are dealt into groups by a hash of the key; each group is broadcast to the rows of its hash alone."""
    groups = max(1, -(-n_keys // most))
    mine = lambda df, i: df.filter(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(groups)) == i) if groups > 1 else df
    return reduce(DataFrame.union, [mine(rows, i).join(F.broadcast(mine(keys, i)), column, how) for i in range(groups)])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out of every fit."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4))


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores as it takes to be none of taken, whatever the case."""
    while name.lower() in [c.lower() for c in taken]:
        name += "_"
    return name


def tidy() -> None:
    """Return freed memory to the system; a worker serves one task after another, and what it holds counts for its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_task(function):
    """function for mapInArrow, with memory returned when it ends."""

    def run(batches):
        tidy()
        try:
            yield from function(batches)
        finally:
            tidy()

    return run


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_IS_ASCII_NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A fixed odd base with its inverse modulo 2**64, and a fixed random value for each byte.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """Words of a batch of texts as byte ranges: start, end (in `data`), doc (row of the batch)."""

    def __init__(self, texts: pa.Array, lower: bool = True, separators: np.ndarray = _IS_SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        self.n_docs = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        values = texts.buffers()[2]
        raw = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = _LOWER[raw] if lower else raw
        word = ~separators[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        starts, ends = word.copy(), word.copy()
        if len(raw):
            starts[1:] &= ~word[:-1] | edge[1:-1]
            ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        #: words of document i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self, stop: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (up to stop, if given), the same in every process and batch."""
        stop = self.end if stop is None else stop
        out = np.empty(len(self.start), np.uint64)
        step = 1 << 19
        for lo in range(0, len(self.start), 1 << 16):  # pieces keep the intermediate arrays in cache
            s, e = self.start[lo : lo + (1 << 16)], stop[lo : lo + (1 << 16)]
            a, b = int(s[0]), int(e.max())
            n = b - a
            table_, inverse = _power_tables(max(n, step))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data[a:b]] * table_[:n], out=sums[1:])
            out[lo : lo + (1 << 16)] = mix((sums[e - a] - sums[s - a]) * inverse[s - a] + (e - s).astype(np.uint64))
        return out


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], also where that is empty."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int = 11) -> DataFrame:
    """Documents with a label, without held-out ones: about max_rows at most, chosen by a hash of the id (a documented bound)."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 24)) < int(max_rows / n * (1 << 24)))
    return docs.join(small(rows, 40 * min(n, 2 * max_rows)), "doc_id")


_TABLES: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    global _TABLES
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES = [powers(_BASE, n), powers(_INVERSE, n)]
    return _TABLES


def spread(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i] + 1, ... (counts[i] of them) for every i, as one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - first, counts)
