"""SentencePiece encoding and decoding over shared prefixes.

Text is marked (spaces become U+2581, one more stands before the text) and cut into marked words, which no piece spans. The
distinct words of a batch are sorted, so that they form a trie in depth-first order, and each is encoded from where it leaves
the word before it: the forward states of the common prefix are reused. An automaton over the pieces goes along, whose state
names all pieces that end at a place.

For a unigram model the state of a prefix is its best score and last piece (Viterbi). The public model is a byte-pair model,
whose segmentation isn't the best-scored one; there the state is the last piece of the prefix's own encoding. That is enough:
pieces make up an encoding exactly when each neighbouring pair, encoded alone, stays that pair. Characters without a piece
fall back to bytes, or to the unknown piece where the model has no byte pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_task, spread, table
from corpusforge.llm.tokens import slices

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNIGRAM, BPE = 1, 2


def proto_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + n]
        at += n


class PieceCoder:
    """ids of whole texts by a SentencePiece model (unigram or byte-pair) with identity normalisation and a dummy prefix.

    Words and their ids are kept between batches, up to max_words of them, then forgotten. Scores are summed in double
    precision; of segmentations that score alike the one whose last piece is longest wins, at every place.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        parts = dict(proto_fields(model.serialized_model_proto()))
        trainer, normalizer = dict(proto_fields(parts.get(2, b""))), dict(proto_fields(parts.get(3, b"")))
        self.kind = trainer.get(3, UNIGRAM)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        usual = [i for i in range(len(self.pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.unknown = model.unk_id()
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or any(MARK in self.pieces[i].lstrip(MARK) for i in usual):
            raise ValueError("not a unigram or byte-pair model without normalisation whose pieces stay within words")
        self.number = {self.pieces[i]: i for i in usual}
        self.score = {self.pieces[i]: model.get_score(i) for i in usual}
        self.unknown_score = min(self.score.values(), default=0.0) - 10
        self.beginnings = {p[:n] for p in self.number for n in range(1, len(p) + 1)}
        # states: the longest end of what was read that some piece begins with; made as they are met
        self.states, self.steps, self.ending = {"": 0}, [{}], [()]
        self.names = [""]
        self.valid: dict[int, bool] = {}
        self.byte_of = np.full(len(self.pieces), -1)
        for b, i in self.bytes.items():
            self.byte_of[i] = b
        self.max_words = max_words
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.count, self.first, self.n_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text, best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _step(self, state: int, c: str) -> int:
        """The state after c; ending[state]: (id, length) of the pieces that end there, longest first. A character without a piece
        has the id -1 - its code point."""
        text = self.names[state] + c
        while text and text not in self.beginnings:
            text = text[1:]
        key = text or c  # a character that no piece begins with keeps a state of its own
        if (to := self.states.get(key)) is None:
            to = self.states[key] = len(self.names)
            self.names.append(text)
            self.steps.append({})
            found = [(self.number[key[k:]], len(key) - k) for k in range(len(key)) if key[k:] in self.number]
            self.ending.append(tuple(found if c in self.number else [*found, (-1 - ord(c), 1)]))
        self.steps[state][c] = to
        return to

    def byte_pairs(self, words: list[str]) -> Iterator[list[int]]:
        """Encodings of ascending words; last[i] is the id of the last piece of the first i characters, size[i] its length."""
        steps, ending, valid = self.steps, self.ending, self.valid
        last, size, state, base = [0], [0], [0], [0]
        before = ""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], state[shared + 1 :], base[shared + 1 :]
            at = state[shared]
            for i in range(shared, len(word)):
                c = word[i]
                at = to if (to := steps[at].get(c)) is not None else self._step(at, c)
                for b, n in ending[at]:
                    key = base[i + 1 - n] + b
                    if (stays := valid.get(key)) is None:
                        if len(valid) > 2_000_000:
                            valid.clear()
                        pair = [*([self._piece(last[i + 1 - n])] if n <= i else []), self._piece(b)]
                        stays = valid[key] = self.merged("".join(pair)) == pair
                    if stays:
                        last.append(b)
                        size.append(n)
                        state.append(at)
                        base.append((b + 0x200000) * 0x400000)
                        break
            before = word
            yield self._backwards(last, size, len(word))

    def _piece(self, b: int) -> str:
        return self.pieces[b] if b >= 0 else chr(-1 - b)

    def best_scored(self, words: list[str]) -> Iterator[list[int]]:
        """Best-scored encodings of ascending words: score[i] is the forward score of the first i characters, last[i] and size[i]
        its last piece."""
        steps, ending, worth = self.steps, self.ending, {i: self.score[p] for p, i in self.number.items()}
        score, last, size, state = [0.0], [0], [0], [0]
        before = ""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del score[shared + 1 :], last[shared + 1 :], size[shared + 1 :], state[shared + 1 :]
            at = state[shared]
            for i in range(shared, len(word)):
                c = word[i]
                at = to if (to := steps[at].get(c)) is not None else self._step(at, c)
                best = None
                for b, n in ending[at]:
                    mine = score[i + 1 - n] + (worth[b] if b >= 0 else self.unknown_score)
                    if best is None or mine > best:
                        best, place, length = mine, b, n
                score.append(best)
                last.append(place)
                size.append(length)
                state.append(at)
            before = word
            yield self._backwards(last, size, len(word))

    def _backwards(self, last: list[int], size: list[int], i: int) -> list[int]:
        out = []
        while i:
            b = last[i]
            if b >= 0:
                out.append(b)
            elif self.bytes:
                out += [self.bytes[x] for x in reversed(chr(-1 - b).encode())]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one piece
                out.append(self.unknown)
            i -= size[i]
        return out[::-1]

    def _learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet."""
        new = sorted(words)
        base = len(self.index)
        self.index.update(zip(new, range(base, base + len(new))))
        ids: list[int] = []
        counts = []
        for found in (self.byte_pairs if self.kind == BPE else self.best_scored)(new):
            ids += found
            counts.append(len(found))
        count = np.array(counts, np.int64)
        self.first = np.concatenate([self.first, self.n_ids + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat.append(np.array(ids, np.int32))
        self.n_ids += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (without nulls), and how many each has."""
        if len(self.index) > self.max_words:
            self.forget()
        # a word follows each lone space; other texts are cut one by one
        odd = pc.match_substring_regex(texts, f"  |^ | $|{MARK}").to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(texts) else np.zeros(1, np.int64)
        words = lists.flatten().dictionary_encode()
        names = [MARK + w for w in words.dictionary.to_pylist()]
        own = np.flatnonzero(odd | empty).tolist()
        cuts = [_WORD.findall(MARK + text.replace(" ", MARK)) if (text := texts[i].as_py()) else [] for i in own]
        index = self.index
        self._learn(list({w for part in (names, *cuts) for w in part if w not in index}))
        numbers = np.fromiter(map(index.__getitem__, names), np.int64, len(names))
        at = numbers[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        sizes = np.diff(offsets)
        if own:
            parts, done = [], 0
            for i, cut in zip(own, cuts):
                parts += [at[done : offsets[i]], np.array([index[w] for w in cut], np.int64)]
                done, sizes[i] = offsets[i + 1], len(cut)
            at = np.concatenate([*parts, at[done:]])
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        counts = self.count[at]
        before = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[0][spread(counts, self.first[at])], np.diff(before[np.concatenate([[0], np.cumsum(sizes)])])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces together, runs of byte pieces as UTF-8, the dummy prefix left out."""
        pieces = self.pieces
        if (self.byte_of[ids] < 0).all():
            text = "".join([pieces[i] for i in ids.tolist()])
        else:
            raw = b"".join([pieces[i].encode() if b < 0 else bytes([b]) for i, b in zip(ids.tolist(), self.byte_of[ids].tolist())])
            text = raw.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_CODERS: dict[str, PieceCoder] = {}


def _coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of every row of docs (doc_id, text); null and empty texts have no ids, repeated rows equal ones."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                ids, counts = coder.encode(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(arrow_task(encode), "doc_id bigint, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of ids as little-endian 32-bit numbers) and text of rows of doc_id and ids (null: none)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                lists = part.column("ids")
                offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                rows = [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array([zlib.crc32(r) for r in rows], pa.int64()), pa.array([coder.decode(r) for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_crc32", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(arrow_task(decode), "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of encoding every whole text and decoding it again: text_crc32 is of the decoded text. Null and empty texts have
    no ids, repeated rows equal ones, an empty table no rows."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", F.crc32("text").alias("text_crc32"), F.length("text").cast("long").alias("text_chars"))
