"""Packing along a space-filling curve.

Each document's words are hashed to a vector of counts, projected to a few dimensions, and the point's Hilbert key orders
the documents: neighbours along the curve have like words. Ranges of the curve, of about equal bytes, are packed apart: the
ids of a range form one stream, cut every `length` ids, so that only the end of a range could need padding; that end is cut
into lengths that are powers of two, which need none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import Words, arrow_task, partitions, table
from corpusforge.llm.tokens import coder, slices

DIMS, BITS, BUCKETS = 4, 12, 1024


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points (n x dims, integers of so many bits)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of all levels above the last
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] ^ t) >> b & 1
    return key


def document_points(texts: pa.Array, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Integer points of texts: hashed word counts on the unit sphere, projected, each axis cut into 2**bits steps."""
    words = Words(texts)
    bucket = (words.hashes() % np.uint64(BUCKETS)).astype(np.int64)
    random = np.random.default_rng(7).standard_normal((BUCKETS, dims))
    sums = np.zeros((words.n_docs, dims))
    norms = np.zeros(words.n_docs)
    for lo in range(0, words.n_docs, 512):
        hi = min(words.n_docs, lo + 512)
        mine = slice(words.first[lo], words.first[hi])
        counts = np.bincount((words.doc[mine] - lo) * BUCKETS + bucket[mine], minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
        sums[lo:hi] = counts @ random
        norms[lo:hi] = np.sqrt((counts.astype(float) ** 2).sum(1))
    unit = sums / np.maximum(norms, 1)[:, None]
    steps = 1 << bits
    return np.clip(((np.tanh(unit / 2) + 1) / 2 * steps).astype(np.int64), 0, steps - 1)


def with_range(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """doc_id, text (null: empty), place (on the curve, then by a hash of doc_id) and part, the range of the place."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text")
                place = hilbert_key(document_points(texts), BITS) << 15 | part.column("h").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts, pa.array(place, pa.int64()), pa.array(np.searchsorted(shared.value, place, side="right"), pa.int32())], ["doc_id", "text", "place", "part"])

    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 49)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h")).mapInArrow(arrow_task(keyed), "doc_id bigint, text string, place bigint, part int")


def range_bounds(docs: DataFrame, parts: int, rows_a_part: int = 100, most: int = 1_000_000) -> np.ndarray:
    """Ascending places that cut docs into ranges of about equal bytes, from about rows_a_part rows a range (most in all).

    The rows are chosen by a hash of doc_id and text; they decide only where ranges end.
    """
    n = docs.count()
    share = min(1.0, min(most, rows_a_part * parts) / max(1, n))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1 << 24)) < int(share * (1 << 24)))
    rows = with_range(some, np.zeros(0, np.int64)).select("place", (F.octet_length("text") + 1).alias("size")).toArrow()
    place, size = rows.column("place").to_numpy(), rows.column("size").to_numpy().astype(np.int64)
    order = np.argsort(place, kind="stable")
    sums = np.cumsum(size[order])
    if not len(sums):
        return np.zeros(0, np.int64)
    cuts = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)
    return np.unique(place[order][np.minimum(cuts, len(place) - 1)])


def cut_stream(total: int, length: int) -> np.ndarray:
    """Starts of the sequences of a stream, with its end: full ones, then powers of two."""
    full, rest = divmod(total, length)
    ends = [length] * full
    b = 1 << max(0, rest.bit_length() - 1)
    while rest:
        if rest >= b:
            ends.append(b)
            rest -= b
        b >>= 1
    return np.concatenate([[0], np.cumsum(ends)]).astype(np.int64)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most `length` ids; docs needs doc_id and text, with or without others.

    A null or empty text has its end id alone. Rows of one doc_id are packed one by one. A document longer than a sequence
    is cut where sequences end. sequence_id is the range's number times 2**32 plus the place in the range. An empty table
    gives no pieces.
    """
    schema = PIECES + ", ids array<bigint>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = coder(tokenizer)
        part = 0
        first_sequence = 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, ids in all, ids: the open sequence
        n_held = 0

        def emit(rows: list[tuple], cuts: np.ndarray) -> pa.RecordBatch:
            """Deal the ids of rows, in order, to sequences between cuts."""
            nonlocal first_sequence
            sizes = np.array([len(r[3]) for r in rows])
            starts = np.cumsum(sizes) - sizes
            edges = np.union1d(np.concatenate([starts[sizes > 0], [sizes.sum()]]), cuts)
            row = np.searchsorted(starts, edges[:-1], side="right") - 1
            sequence = np.searchsorted(cuts, edges[:-1], side="right") - 1
            inside = edges[:-1] - starts[row]
            n = np.diff(edges)
            pieces_ = [rows[r][3][a : a + k] for r, a, k in zip(row.tolist(), inside.tolist(), n.tolist())]
            out = {
                "doc_id": pa.array([rows[r][0] for r in row.tolist()], pa.int64()),
                "start": pa.array(np.array([r[1] for r in rows])[row] + inside, pa.int64()),
                "length": pa.array(n, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p) for p in pieces_], pa.int64()),
                "doc_tokens": pa.array(np.array([r[2] for r in rows])[row], pa.int64()),
                "sequence_id": pa.array((part << 32) + first_sequence + sequence, pa.int64()),
                "offset": pa.array(edges[:-1] - cuts[sequence], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(pieces_).astype(np.int64)))
            first_sequence += len(cuts) - 1
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            if doc_ids:
                part = batch.column("part")[0].as_py()
            for lo, hi in slices(texts, 1 << 18):
                ids, counts = tokens.encode(texts.slice(lo, hi - lo))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                ends = np.cumsum(counts + 1)
                for d, e, n in zip(doc_ids[lo:hi], ends.tolist(), (counts + 1).tolist()):
                    held.append((d, 0, n, ids[e - n : e]))
                n_held = sum(len(r[3]) for r in held)
                if n_held >= length:
                    keep = n_held % length  # the last ids wait for the next documents
                    rest, left = [], keep
                    while left:
                        d, s, n, x = held.pop()
                        k = min(left, len(x))
                        rest.append((d, s + len(x) - k, n, x[len(x) - k :].copy()))
                        if k < len(x):
                            held.append((d, s, n, x[: len(x) - k]))
                        left -= k
                    yield emit(held, np.arange(0, n_held - keep + 1, length))
                    held = rest[::-1]
        if held:
            yield emit(held, cut_stream(sum(len(r[3]) for r in held), length))

    parts = partitions(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    ranged = with_range(texts, range_bounds(texts, parts)).repartitionById(parts, "part").sortWithinPartitions("place", "doc_id")
    return ranged.select("doc_id", "text", "part").mapInArrow(arrow_task(pieces), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, null and empty texts (their end id alone) included; an empty table gives none."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, with_ids=False)
