import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from corpusforge.llm.sentencepiece_codec import PieceCoder, decode_pieces, encode_pieces, op9_sentencepiece
from tests.conftest import SMALL

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["", " ", "  ", "\n", "▁", "the", "Thing", "é", "☃", "日本", "\t", "....", "xyzzy", "12345", "\U0001f600"]


def test_encoding_is_the_librarys():
    library, coder, rng = SentencePieceProcessor(model_file=MODEL), PieceCoder(MODEL, max_words=300), random.Random(5)
    texts = ["", " ", "a", "  a  b "] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 15))) for _ in range(2000)]
    for lo in range(0, len(texts), 250):
        some = texts[lo : lo + 250]
        ids, counts = coder.encode(pa.array(some, pa.string()))
        ends = np.cumsum(counts)
        for t, e, n in zip(some, ends, counts):
            mine, want = ids[e - n : e], library.encode(t)
            assert mine.tolist() == want, repr(t)
            assert coder.decode(mine) == library.decode(want), repr(t)


def test_query_round_trip(spark):
    library = SentencePieceProcessor(model_file=MODEL)
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op9_sentencepiece(spark, SMALL).collect():
        ids = np.array(library.encode(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_crc32"], r["text_crc32"]) == (len(ids), zlib.crc32(ids), zlib.crc32(texts[r["doc_id"]].encode()))


def test_odd_rows(odd_docs, no_docs):
    rows = decode_pieces(encode_pieces(odd_docs, MODEL), MODEL).collect()
    assert sorted(r["text"] for r in rows) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert encode_pieces(no_docs, MODEL).count() == 0


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def unigram_model(path, pieces, fallback, squeeze=0):
    """A model file of given pieces and scores; nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback] + [(p, s, 1) for p, s in pieces]
    raw = b"".join(_field(1, _field(1, p) + _field(2, s) + _field(3, k)) for p, s, k in rows)
    raw += _field(2, _field(3, 1) + _field(35, int(fallback))) + _field(3, _field(1, "identity") + _field(3, 1) + _field(4, squeeze) + _field(5, 1))
    path.write_bytes(raw)
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
def test_best_scored_segmentation_is_the_librarys(tmp_path, fallback):
    rng = random.Random(8)
    pieces = {"▁": -4.0} | {c: -rng.randint(256, 512) / 64 for c in "abc"}
    for _ in range(150):
        p = rng.choice(["", "▁"]) + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
        pieces.setdefault(p, -rng.randint(128, 1000) / 64)  # sums of such scores are exact
    model = unigram_model(tmp_path / "m", pieces.items(), fallback)
    library, coder = SentencePieceProcessor(model_file=model), PieceCoder(model, max_words=200)
    texts = ["", " ", "abc  cab "] + ["".join(rng.choice("aabbcc  é☃x") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for lo in range(0, len(texts), 100):
        some = texts[lo : lo + 100]
        ids, counts = coder.encode(pa.array(some, pa.string()))
        for t, e, n in zip(some, np.cumsum(counts), counts):
            mine, want = ids[e - n : e].tolist(), library.encode(t)
            assert mine == want or score(coder, mine) == score(coder, want), repr(t)  # ties may differ


def score(coder, ids):
    return sum(coder.score.get(coder.pieces[i], coder.unknown_score) for i in ids if coder.byte_of[i] < 0), "".join(coder.pieces[i] for i in ids)


def test_models_that_normalise_are_refused(tmp_path):
    with pytest.raises(ValueError):
        PieceCoder(unigram_model(tmp_path / "m", [("▁", -1.0), ("a", -1.0)], True, squeeze=1))
    with pytest.raises(ValueError):
        PieceCoder(unigram_model(tmp_path / "n", [("▁", -1.0), ("a▁b", -1.0)], True))
