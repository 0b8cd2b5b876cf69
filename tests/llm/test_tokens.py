import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusforge.llm.packing import cut_stream, hilbert_key, op8_packing, pack, range_bounds, with_range
from corpusforge.llm.token_files import decode_block, encode_block, op7_token_files, read_image, read_token_files, write_image, write_token_files
from corpusforge.llm.tokens import KNOWN, Coder
from tests.conftest import SMALL

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", " \n", "\n\n", "\t", "\x1c", " ", "the", "The", "FOO!!", "naïve", "É", "é", "don't", "'s", "12", "☃", "日本", ".", "...", "<|endoftext|>", "Σ", "İ", "x$$", "a.b"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_coder_gives_the_librarys_ids(path):
    rng = random.Random(4)
    known = [chr(c) for a, b in KNOWN for c in range(a, b + 1)]
    texts = ["", " ", "a", " a", "a ", " \n" * 400_000 + "x", "ab" * 50_000] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += [frame.replace("X", c) for c in known for frame in ("X", "aXb", " X ", "X X", "1X1", "!X!", "'X", " Xs", "X\n")]
    pool = known + [" ", "'s", "'re", "'LL", "''", "don't"] * 20
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 20))) for _ in range(5000)]
    coder = Coder(path)
    assert coder.fast is not None
    plain = Tokenizer.from_file(path)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    texts += [frame.replace("X", t) for t in added for frame in ("X", "aX", "X b", "aXXb", " X ", "<X>", "X\n\n")] + [t.upper() for t in added] + [t[:-1] for t in added]
    assert any(t in x for x in texts for t in added)
    for lo in range(0, len(texts), 500):
        some = texts[lo : lo + 500]
        ids, counts = coder.encode(pa.array(some, pa.string()))
        ends = np.cumsum(counts)
        for t, e, n, own in zip(some, ends, counts, plain.encode_batch_fast(some, add_special_tokens=False)):
            assert ids[e - n : e].tolist() == own.ids, repr(t[:50])


def test_files_of_other_kinds_go_through_the_library(tmp_path):
    with open(BYTE, encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    (tmp_path / "a.json").write_text(json.dumps(spec), encoding="utf-8")
    coder = Coder(str(tmp_path / "a.json"))
    assert coder.fast is None
    assert coder.encode(pa.array(["so it is"]))[0].tolist() == coder.tokenizer.encode("so it is").ids


def test_without_the_fast_loop_the_library_does_all(monkeypatch):
    monkeypatch.setattr("importlib.util.find_spec", lambda name: None)
    coder = Coder(BYTE)
    assert coder.fast is None and coder.encode(pa.array(["so it is<|endoftext|>"]))[0].tolist() == Tokenizer.from_file(BYTE).encode("so it is<|endoftext|>", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1)), max_size=300))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    assert decode_block(encode_block(ids), len(ids)).tolist() == values


def test_images_know_damage():
    image = write_image([1, None, 3], np.array([2, 0, 1]), np.array([5, 6, 7]))
    doc_ids, counts, ids = read_image(image)
    assert doc_ids == [1, None, 3] and counts.tolist() == [2, 0, 1] and ids.tolist() == [5, 6, 7]
    with pytest.raises(ValueError):
        read_image(image[:-9] + b"x" + image[-8:])


def test_token_files_against_the_tokenizer(spark):
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    plain, start, want = Tokenizer.from_file(WORD), 0, {}
    for d, text in docs:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op7_token_files(spark, SMALL).collect()} == want


def test_odd_rows_in_files(spark, odd_docs, no_docs, tmp_path):
    write_token_files(odd_docs, f"file://{tmp_path}/a", WORD, 2, image_ids=50)
    rows = sorted(read_token_files(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r["start"])
    assert len(rows) == 15 and rows[0]["doc_id"] is None and [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in rows)
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(15)]
    write_token_files(no_docs, f"file://{tmp_path}/b", WORD, 2)
    assert read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def test_hilbert_neighbours_touch():
    side = 8
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    path = points[np.argsort(hilbert_key(points, 3))]
    assert sorted(hilbert_key(points, 3).tolist()) == list(range(side * side))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_cut_stream():
    for total in (0, 1, 2047, 2048, 5000):
        sizes = np.diff(cut_stream(total, 2048))
        assert sizes.sum() == total and all(n == 2048 or n & (n - 1) == 0 for n in sizes.tolist())


def check_pieces(rows, ids):
    total = {}
    sequences = {}
    for r in rows:
        whole = ids[r["doc_id"]]
        piece = whole[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(whole) and r["length"] > 0
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == {d: len(x) for d, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_packing_against_the_tokenizer(spark):
    plain = Tokenizer.from_file(BYTE)
    ids = {r["doc_id"]: np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_pieces(op8_packing(spark, SMALL).collect(), ids)


def test_packing_odd_rows(odd_docs, no_docs):
    rows = pack(odd_docs, BYTE, 1).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert pack(no_docs, BYTE, 1).count() == 0


def test_ranges_have_like_bytes(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' '), cast(if(id % 7 = 3, 300, 3) as int)) as text")
    bounds = range_bounds(docs, 8)
    sizes = [r["s"] for r in with_range(docs, bounds).groupBy("part").agg(F.sum(F.octet_length("text")).alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * np.median(sizes)
