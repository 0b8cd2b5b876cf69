"""Ids of whole texts by a byte-pair tokenizer file of the tokenizers library, in batches and without a cache.

The ids are those of the library. Texts of known characters (Latin letters, ASCII, common punctuation) are merged
by tiktoken's loop over the merges of the same file, which builds no offsets or strings for each token; all others go through
the library itself. That loop takes a merge by what it makes, not by its two parts: when a file is loaded its merges must
stand in the order of their ids, and every piece of the vocabulary must give the same ids both ways, or the library does all.
"""

from __future__ import annotations

import importlib.util
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Patterns and normalisers that the fast way knows (fixed values, as the files have them).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose classes are known: Latin with marks (lower case of U+0130 has two characters), dashes, quotes, dots, the euro sign.
KNOWN = [(0, 0x84), (0x86, 0x9F), (0xA1, 0x12F), (0x131, 0x17F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
_UNKNOWN = "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in KNOWN) + "]"
_SPACES = [*range(9, 14), 32]
_SPACE, _LETTER, _DIGIT, _OTHER = range(1, 5)
#: Ends of pieces have characters of their own, U+0200 + byte; bytes beyond ASCII have U+0100 + byte.
_SYMBOLS = np.array([b if b < 128 else 0x100 + b for b in range(256)] + [0x200 + b for b in range(256)], np.uint32)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point up to U+20AC."""
    kind, lower = np.zeros(0x20AD, np.uint8), np.arange(0x20AD, dtype=np.uint32)
    for a, b in KNOWN:
        for c in range(a, b + 1):
            first = unicodedata.category(chr(c))[0]
            kind[c] = _SPACE if c in _SPACES else _LETTER if first == "L" else _DIGIT if first == "N" else _OTHER
            lower[c] = ord(chr(c).lower())
    return kind, lower


_KIND, _LOWER = _classes()


def _letters_of_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabularies of bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Coder:
    """ids of texts by the tokenizer file at path. A text with an added token's string goes through the library, which gives that token its own id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = (spec["model"].get("end_of_word_suffix") or "") != ""
        added = spec.get("added_tokens") or []
        self.odd = "|".join([_UNKNOWN, *(re.escape(t["content"]) for t in added)])  # texts that the library encodes
        # a token that is looked for in the normalised text may stand in it in other forms
        self.fast = None if any(t.get("normalized") for t in added) else self._merges(spec)

    def _merges(self, spec: dict):
        """The fast coder, if the file is of a kind that it serves."""
        if importlib.util.find_spec("tiktoken") is None:
            return None
        import tiktoken

        model, cut = spec["model"], json.dumps(spec.get("pre_tokenizer"), sort_keys=True)
        known = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and not spec.get("truncation")
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        wordwise = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, bytewise | {"use_regex": False}]}
        folding = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
        want = (wordwise, folding) if self.words else (bytewise, None)
        suffix = model.get("end_of_word_suffix") or ""
        if not known or (cut, spec.get("normalizer")) != (json.dumps(want[0], sort_keys=True), want[1]) or suffix not in ("", "</w>"):
            return None
        byte = _letters_of_bytes()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if made != sorted(set(made)) or len(made) + (512 if self.words else 256) != len(model["vocab"]) or (made and made[0] != len(model["vocab"]) - len(made)):
            return None
        ranks = {}
        for piece, i in model["vocab"].items():
            if self.words:
                end = piece.endswith(suffix)
                raw = [byte[c] for c in (piece[: -len(suffix)] if end else piece)]
                marked = np.array(raw) + 256 * (np.arange(len(raw)) == len(raw) - 1) * end
                ranks["".join(map(chr, _SYMBOLS[marked].tolist())).encode()] = i
            else:
                ranks[bytes(byte[c] for c in piece)] = i
        pattern = "[^Ȁ-˿]*[Ȁ-˿]" if self.words else BYTE_PATTERN
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return fast if self._agrees(fast, model["vocab"], suffix, byte) else None

    def _agrees(self, fast, vocab: dict[str, int], suffix: str, byte: dict[str, int]) -> bool:
        pieces = [p for p in vocab if p.endswith(suffix)]
        raw = [bytes(byte[c] for c in p[: len(p) - len(suffix)]) for p in pieces]
        texts = pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())
        texts = texts.filter(pc.invert(pc.match_substring_regex(texts, self.odd)))
        own = self._library(texts.to_pylist())
        self.fast = fast
        plain = self._fast(texts)
        return plain is not None and np.array_equal(plain[1], own[1]) and np.array_equal(plain[0], own[0])

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for f in found for i in f), np.uint32, int(counts.sum())), counts

    def _marked(self, texts: list[str]) -> tuple[str, np.ndarray]:
        """All texts, lower-cased and without white space, the last byte of each piece marked, and where each text ends."""
        points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
        low, kind = _LOWER[points], _KIND[points]
        first = kind == _DIGIT
        first[0] |= kind[0] != _SPACE
        first[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != _SPACE)
        for i in np.flatnonzero(first & (low == 39)).tolist():  # contractions: an apostrophe that opens a piece
            tail = low[i + 1 : i + 3].tobytes().decode("utf-32-le")
            n = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
            if n:
                first[i + 1] = False
                first[i + n + 1] = kind[i + n + 1] != _SPACE
        inside = kind != _SPACE
        last = inside.copy()  # a space stands at the end, so that every piece ends before another place
        last[:-1] &= first[1:] | ~inside[1:]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        low, last = low[inside], last[inside]
        before = np.concatenate([[0], np.cumsum(inside)])
        ends = before[ends]
        if len(low) and low.max() >= 128:
            width = 1 + (low >= 0x80).astype(np.int64) + (low >= 0x800)
            place = np.cumsum(width)
            symbols = np.frombuffer(low.tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
            symbols[place[last] - 1] += 256
            ends = np.concatenate([[0], place])[ends]
        else:
            symbols = low + np.uint32(256) * last
        return _SYMBOLS[symbols].tobytes().decode("utf-32-le"), ends

    def _fast(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """ids and counts, or None if some text is too much for the pattern's stack."""
        encode, rows = self.fast._core_bpe.encode_to_tiktoken_buffer, texts.to_pylist()
        if self.words:
            text, ends = self._marked(rows)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            rows = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        try:
            found = [np.frombuffer(encode(row, set()), np.uint32) for row in rows]
        except ValueError:
            return None
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (without nulls), and how many each has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.fast is None:
            return self._library(texts.to_pylist())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            if (found := self._fast(texts)) is not None:
                return found
            if len(texts) == 1:
                return self._library(texts.to_pylist())
        # one text after another, each in its own way
        parts = [self._library([texts[i].as_py()]) if odd[i] else self.encode(texts.slice(i, 1)) for i in range(len(texts))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One for each process; its size doesn't grow with the texts."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def slices(texts: pa.Array, max_bytes: int = 4 << 20):
    """Runs of texts of about max_bytes together, as (from, to)."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + max_bytes, side="right")))
        yield lo, hi
        lo = hi
