"""Spelling variants: words that differ by one inserted, deleted or replaced character, found by two-dimensional range reporting.

Words in forward order and in the order of their reversals are points of a plane. For an edit position the words that agree
before it are an interval of the first order, those that agree after it one of the second, and the words in both are the
near ones: a wavelet tree over the points reports them, without a pair that isn't near. To spread this, positions of a length
are cut into windows, and words go to one task if they agree outside a window (they must, for an edit inside it). A window
whose words are too many is halved, as often as needed: at one position only the alphabet is left, so every bucket is bounded
and nothing is dropped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_task, partitions, saved, small, spread, table
from corpusforge.llm.terms import counted, latin_letters, runs
from corpusforge.llm.tokens import slices

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def crc32_after(before: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, long: int = 64) -> np.ndarray:
    """crc32 of data[start:start + length], each continued from the crc32 before it."""
    order = np.argsort(-length, kind="stable")
    state, at, n = ~before[order].astype(np.uint32), start[order], length[order]
    n_long = int(np.searchsorted(-n, -long, side="left"))
    for p in range(int(n[n_long]) if n_long < len(n) else 0):
        k = int(np.searchsorted(-n, -p, side="left"))
        s = state[n_long:k]
        state[n_long:k] = _TABLE[(s ^ data[at[n_long:k] + p]) & 255] ^ (s >> 8)
    for j in range(n_long):
        state[j] = ~np.uint32(zlib.crc32(data[at[j] : at[j] + n[j]].tobytes(), int(~state[j])))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return out


def slipped_words(docs: DataFrame, one_in: int = 31, min_length: int = 7) -> DataFrame:
    """word and n: runs of Latin letters of all texts, A-Z lower-cased, of at least min_length code points.

    Of a run in a document whose crc32 of "<doc_id>:<run>" is divisible by one_in, the code point at crc32 % length is left
    out first. A null text has no words, a null doc_id is written as nothing. Repeated rows count as often as they stand.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text"), 8 << 20):
                ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                found, doc = runs(batch.column("text").slice(lo, hi - lo), latin_letters)
                words = found.dictionary
                row, code, n = counted(found.indices.to_numpy(), doc, len(words))
                if not len(row):
                    continue
                bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
                data = np.frombuffer(words.buffers()[2], np.uint8)
                before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
                h = crc32_after(before[row], data, bounds[code], bounds[code + 1] - bounds[code])
                hit = h % one_in == 0
                total = np.bincount(code[~hit], n[~hit], len(words)).astype(np.int64)
                whole = (total > 0) & (pc.utf8_length(words).to_numpy() >= min_length)
                cut, cut_n = [], []
                for c, crc, k in zip(code[hit].tolist(), h[hit].tolist(), n[hit].tolist()):
                    run = words[c].as_py()
                    if len(run) > min_length:
                        at = crc % len(run)
                        cut.append(run[:at] + run[at + 1 :])
                        cut_n.append(k)
                out = pa.concat_arrays([words.filter(pa.array(whole)).cast(pa.string()), pa.array(cut, pa.string())])
                yield pa.RecordBatch.from_arrays([out, pa.array(np.concatenate([total[whole], np.array(cut_n, np.int64)]))], ["word", "n"])

    rows = docs.select("doc_id", "text").filter("text is not null")
    return rows.mapInArrow(arrow_task(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """A permutation's values, level by level from the highest bit; answers which of them lie in a range of places and of values."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for level in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            high = (values >> level) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~high)])
            self.levels.append((level, zeros))
            values = np.concatenate([values[~high], values[high]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each value in [low, high) at a place in [lo, hi), for all queries at once."""
        query, base = np.flatnonzero((hi > lo) & (high > low)), None
        lo, hi, base = lo[query], hi[query], np.zeros(len(query), np.int64)
        for level, zeros in self.levels:
            lo0, hi0 = zeros[lo], zeros[hi]
            query = np.concatenate([query, query])
            base = np.concatenate([base, base + (1 << level)])
            lo, hi = np.concatenate([lo0, zeros[-1] + lo - lo0]), np.concatenate([hi0, zeros[-1] + hi - hi0])
            live = (hi > lo) & (base < high[query]) & (base + (1 << level) > low[query])
            query, base, lo, hi = query[live], base[live], lo[live], hi[live]
        return query, base


def _intervals(words: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words (an array of strings) by bucket: the order, and for each word and p the interval of those that share its
    bucket and its first p characters."""
    order = np.argsort(words, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    m, width = len(words), words.dtype.itemsize // 4
    chars = words[order].view(np.uint32).reshape(m, width)
    differ = chars[1:] != chars[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    shared[bucket[order][1:] != bucket[order][:-1]] = -1
    p, at = np.arange(width + 1), np.arange(m, dtype=np.int32)[:, None]
    starts = np.concatenate([[-1], shared])[:, None] < p
    ends = np.concatenate([shared, [-1]])[:, None] < p
    lo, hi = np.empty((m, width + 1), np.int32), np.empty((m, width + 1), np.int32)
    lo[order] = np.maximum.accumulate(np.where(starts, at, 0), axis=0)
    hi[order] = np.minimum.accumulate(np.where(ends, at + 1, m)[::-1], axis=0)[::-1]
    return order, lo, hi


def near_in_buckets(words: np.ndarray, lengths: np.ndarray, bucket: np.ndarray, base: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Near words of one bucket, by an edit at a position from a to b - 1 of a word of the bucket's base length: (row, near
    row), both ways. Words of a bucket are distinct and are base or base + 1 long; each pair is reported in one window only."""
    m, width = len(words), words.dtype.itemsize // 4
    chars = words.view(np.uint32).reshape(m, width)
    back = lengths[:, None] - 1 - np.arange(width)
    reversed_ = np.where(back >= 0, np.take_along_axis(chars, np.maximum(back, 0), 1), 0).astype(np.uint32).view(f"<U{width}").reshape(m)
    order_f, lo_f, hi_f = _intervals(words, bucket)
    order_r, lo_r, hi_r = _intervals(reversed_, bucket)
    short = lengths == base
    rows, near = [], []
    for of_base in (True, False):  # near words of the same length, then those that are one longer
        member = short if of_base else ~short
        if not member.any():
            continue
        count_f, count_r = (np.concatenate([[0], np.cumsum(member[o])]) for o in (order_f, order_r))
        by_reversal = order_r[member[order_r]]
        place = np.empty(m, np.int64)
        place[by_reversal] = np.arange(len(by_reversal))
        tree = WaveletTree(place[order_f[member[order_f]]])
        asking = np.flatnonzero(short)
        n = np.maximum(np.minimum(b[asking], base[asking] + (0 if of_base else 1)) - a[asking], 0)
        j, i = np.repeat(asking, n), spread(n, a[asking])
        after = base[j] - i - (1 if of_base else 0)
        least = 2 if of_base else 1  # a word lies in its own intervals
        x1, x2, y1, y2 = count_f[lo_f[j, i]], count_f[hi_f[j, i]], count_r[lo_r[j, after]], count_r[hi_r[j, after]]
        ask = np.flatnonzero((x2 - x1 >= least) & (y2 - y1 >= least))
        for s in range(0, len(ask), step):
            k = ask[s : s + step]
            query, value = tree.report(x1[k], x2[k], y1[k], y2[k])
            of, to, at = j[k][query], by_reversal[value], i[k][query]
            # of the places where an insertion gives the same word the first counts
            new = of != to if of_base else (at == 0) | (chars[of, np.maximum(at - 1, 0)] != chars[to, at])
            rows += [of[new]] if of_base else [of[new], to[new]]
            near += [to[new]] if of_base else [to[new], of[new]]
    return (np.concatenate(rows), np.concatenate(near)) if rows else (np.zeros(0, np.int64),) * 2


def _windows(first: str) -> str:
    return f"struct({first} as base, 0 as a, {first} div 2 as b), struct({first} as base, {first} div 2 as a, {first} + 1 as b)"


_KEY = "xxhash64(base, a, b, substring(word, 1, a), right(word, greatest(base - b, 0)))"


def _in_buckets(words: DataFrame, max_cells: int) -> DataFrame:
    """word, n, base, a, b, bucket: each word in the buckets of its windows, none with over max_cells (word, position)."""
    found = words.select("word", "n", F.length("word").alias("len")).select("word", "n", F.expr(f"explode(array({_windows('len')}, {_windows('(len - 1)')}))").alias("w")).select("word", "n", "w.*")
    found = found.filter("base > 0").withColumn("bucket", F.expr(_KEY))
    settled = []
    while True:
        hot = found.groupBy("base", "a", "b", "bucket").agg(F.count("*").alias("rows")).filter(f"b > a + 1 and rows * (b - a) > {max_cells}").drop("rows")
        hot = saved(hot, "crowded")
        n_hot = hot.count()
        if not n_hot:
            settled.append(found)
            break
        hot, on = small(hot, 32 * n_hot), ["base", "a", "b", "bucket"]
        settled.append(found.join(hot, on, "left_anti").select(found.columns))
        found = found.join(hot, on, "left_semi").select("word", "n", F.expr("explode(array(struct(base, a, (a + b) div 2 as b), struct(base, (a + b) div 2 as a, b)))").alias("w")).select("word", "n", "w.*").withColumn("bucket", F.expr(_KEY))
        found = saved(found, "halved")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.Table]:
    """Whole buckets of about so many cells, from rows in the order of their buckets."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch) * (1 + pc.max(batch.column("base")).as_py()) if len(batch) else 0
        if size >= cells:
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column("bucket").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
            size = (len(rows) - cut) * (1 + rows.column("base")[len(rows) - 1].as_py())
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _alike(rows: pa.Table) -> Iterator[pa.Table]:
    """rows, which are in the order of their base lengths, in parts of like lengths, so that a few long words don't make all wide."""
    base = rows.column("base").to_numpy()
    lo = 0
    while lo < len(base):
        hi = int(np.searchsorted(base, 2 * base[lo] + 16, side="right"))
        yield rows.slice(lo, hi - lo).combine_chunks()
        lo = hi


def near_words(words: DataFrame, max_cells: int = 1 << 19, chunk_cells: int = 1 << 20) -> DataFrame:
    """word, n_near and best (less: its n negated, and near: the word) for each word with a near one; best is the near word of
    largest n, of equal ones the smallest in code-point order. words needs word (distinct, without U+0000) and n."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for chunk in _chunks(batches, chunk_cells) for part in _alike(chunk)):
            n, base, a, b, key = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "base", "a", "b", "bucket"))
            lengths = pc.utf8_length(rows.column("word")).to_numpy().astype(np.int64)
            word = np.array(rows.column("word").to_pylist(), f"<U{max(1, int(lengths.max(initial=1)))}")
            change = (key[1:] != key[:-1]) | (base[1:] != base[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            bucket = np.concatenate([[0], np.cumsum(change)])
            of, near = near_in_buckets(word, lengths, bucket, base, a, b)
            rank = np.empty(len(word), np.int64)
            rank[np.argsort(word, kind="stable")] = np.arange(len(word))
            order = np.lexsort((rank[near], -n[near], of))
            of, near = of[order], near[order]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
            counts = np.diff(np.concatenate([first, [len(of)]]))
            text = rows.column("word").combine_chunks()
            yield pa.RecordBatch.from_arrays([text.take(pa.array(of[first])), pa.array(counts), pa.array(-n[near[first]]), text.take(pa.array(near[first]))], ["word", "n_near", "less", "near"])

    items = _in_buckets(words, max_cells).repartition(partitions(words.sparkSession), "base", "bucket").sortWithinPartitions("base", "a", "b", "bucket")
    parts = items.mapInArrow(arrow_task(report), "word string, n_near bigint, less bigint, near string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def variant_forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n and root for each row of words (word, distinct; n, positive).

    form is the near word of largest n (ties: smallest in code-point order) if that is at least ratio (2 or more) times the
    word's n, else null; root is where following forms ends, the word itself without one. No words: no rows.
    """
    words = saved(words.select("word", "n"), "words")
    own = F.col("best.less") <= -ratio * F.col("n")
    found = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(own, F.col("best.near")).alias("form"), F.when(own, -F.col("best.less")).alias("form_n")
    )
    found = saved(found, "forms")
    most, least = words.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(most / least, ratio) + 1e-9) if most else 0  # each step multiplies n
    roots = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):  # each round doubles the steps taken
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("to"))
        roots = saved(roots.join(onward, "root", "left").select("word", F.coalesce("to", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents that stand at least twice and have 7 code points or more."""
    words = slipped_words(table(spark, sf_dir, "documents")).filter("n >= 2")
    return variant_forms(words)
