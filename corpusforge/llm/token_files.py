"""Token-id files: Simple-8b, word-aligned, with escapes and per-block offsets.

A 64-bit word holds a selector in its top 4 bits and, in the other 60, as many ids as fit at the selector's width. An id of
more than 60 bits has an escape: selector 15, then the id as a word of its own. A file image is one row of the table of
files: header, document table, offsets of blocks, words. Blocks of BLOCK ids are coded apart, so any block can be decoded
alone, and all words of one selector at a time. A range of documents in ascending doc_id order makes one part, a part some
images; a part's ids start after all ids of the parts before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_task, partitions, scratch, small, table
from corpusforge.llm.tokens import coder, slices

#: (ids in a word, bits of each) by selector; selector 14 isn't used, 15 is the escape.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
BLOCK = 1 << 16
MAGIC = b"CFS8"
_COUNTS = np.array([c for c, _ in PACKINGS] + [0, 1])


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least 1."""
    out = np.ones(len(ids), np.uint8)
    rest = ids.astype(np.uint64)
    for shift in (32, 16, 8, 4, 2, 1):
        big = rest >> np.uint64(shift) != 0
        if big.any():
            out += (big * shift).astype(np.uint8)
            rest = np.where(big, rest >> np.uint64(shift), rest)
    return out


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of up to BLOCK ids (unsigned 64-bit at most)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    largest = np.concatenate([_widths(ids), np.zeros(60, np.uint8)])  # beyond the end anything fits
    spans = {1: largest}
    for k in (2, 4, 8, 16, 32):
        half = spans[k // 2]
        spans[k] = np.maximum(half[: len(half) - k // 2], half[k // 2 :])
    selector = np.full(n, ESCAPE, np.uint8)
    for s in range(len(PACKINGS) - 1, -1, -1):  # a later, wider window wins
        c, bits = PACKINGS[s]
        k = 1 << (c.bit_length() - 1)
        widest = spans[k][:n] if c == k else np.maximum(spans[k][:n], spans[k][c - k : c - k + n])
        np.putmask(selector, widest <= bits, s)
    step = _COUNTS.astype(np.uint8)[selector].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    chosen = selector[at]
    place = np.cumsum(1 + (chosen == ESCAPE)) - 1 - (chosen == ESCAPE)
    out = np.zeros(len(at) + int((chosen == ESCAPE).sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(chosen):
        mine = chosen == s
        if s == ESCAPE:
            out[place[mine]] = np.uint64(ESCAPE << 60)
            out[place[mine] + 1] = ids[at[mine]]
            continue
        c, bits = PACKINGS[s]
        word = np.full(int(mine.sum()), np.uint64(int(s) << 60))
        for j in range(c):
            word |= padded[at[mine] + j] << np.uint64(j * bits)
        out[place[mine]] = word
    return out


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)  # words that hold an escaped id; what their top bits say means nothing
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    counts = np.where(raw, 0, _COUNTS[selector])
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector[~raw]):
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == ESCAPE:
            out[first[mine]] = words[mine + 1]
            continue
        c, bits = PACKINGS[s]
        mask = np.uint64((1 << bits) - 1)
        for j in range(c):
            out[first[mine] + j] = words[mine] >> np.uint64(j * bits) & mask
    return out[:n]


def write_image(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = [encode_block(ids[lo : lo + BLOCK]) for lo in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    body = b"".join(
        [
            struct.pack("<QQQ", len(doc_ids), len(ids), len(blocks)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], "<u1").tobytes(),
            np.asarray(counts).astype("<u8").tobytes(),
            offsets.tobytes(),
            *[b.astype("<u8").tobytes() for b in blocks],
        ]
    )
    return MAGIC + body + struct.pack("<I", zlib.crc32(body))


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids; raises ValueError where the image is damaged."""
    body = image[4:-4]
    if image[:4] != MAGIC or zlib.crc32(body) != struct.unpack("<I", image[-4:])[0]:
        raise ValueError("not a whole token file")
    n_docs, n_ids, n_blocks = struct.unpack_from("<QQQ", body)
    at = 24
    doc_ids = np.frombuffer(body, "<i8", n_docs, at)
    known = np.frombuffer(body, "<u1", n_docs, at := at + 8 * n_docs)
    counts = np.frombuffer(body, "<u8", n_docs, at := at + n_docs)
    offsets = np.frombuffer(body, "<u8", n_blocks + 1, at := at + 8 * n_docs).astype(np.int64)
    words = np.frombuffer(body, "<u8", -1, at + 8 * (n_blocks + 1))
    parts = [decode_block(words[offsets[i] : offsets[i + 1]], min(BLOCK, n_ids - i * BLOCK)) for i in range(n_blocks)]
    return [int(d) if k else None for d, k in zip(doc_ids, known)], counts.astype(np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64)


#: base: ids of the part before the image.
IMAGE_SCHEMA = "part int, image int, base bigint, n_docs bigint, n_ids bigint, content binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, image_ids: int = 1_000_000) -> None:
    """Encode docs (doc_id, text) and write their ids, each document's followed by end_id, in ascending doc_id order.

    A null text is empty: it has its end id alone. A null doc_id comes first. Rows of one doc_id follow in the order of a
    hash of their texts. Other columns of docs aren't read. An empty table gives no images.
    """

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = coder(tokenizer)
        held_docs: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[int] = []
        part, n_image, base = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held_docs, held, counts, n_image, base
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "image": pa.array([n_image], pa.int32()), "base": [base], "n_docs": [len(held_docs)], "n_ids": [len(ids)], "content": pa.array([write_image(held_docs, np.array(counts), ids)], pa.binary())})
            held_docs, held, counts, n_image, base = [], [], [], n_image + 1, base + len(ids)
            return out

        size = 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            if doc_ids:
                part = batch.column("part")[0].as_py()
            for lo, hi in slices(texts, 1 << 18):
                ids, n = tokens.encode(texts.slice(lo, hi - lo))
                ends = np.cumsum(n)
                held.append(np.insert(ids, ends, end_id))
                held_docs += doc_ids[lo:hi]
                counts += (n + 1).tolist()
                size += len(held[-1])
                if size >= image_ids:
                    yield flush()
                    size = 0
        if held_docs:
            yield flush()

    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    ranged = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows = ranged.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(arrow_task(images), IMAGE_SCHEMA)
    rows.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if with_ids, ids."""
    schema = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, content in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), batch.column("content")):
                doc_ids, counts, ids = read_image(content.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = {
                    "part": pa.array([part] * len(doc_ids), pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "start": pa.array(base + ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.schema(IMAGE_SCHEMA).parquet(path)
    # the places of parts among all, from the counts alone: one row for each part that was written
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_base"))
    n_parts = files.select("part").distinct().count()
    out = files.select("part", "base", "content").mapInArrow(arrow_task(documents), schema)
    return out.join(small(parts, 32 * n_parts, 64 << 20), "part").withColumn("start", F.col("start") + F.col("part_base")).drop("part", "part_base")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the files: null and empty texts have the end id alone, an empty table no rows."""
    import public_tokenizers

    path = scratch(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path, with_ids=False)
