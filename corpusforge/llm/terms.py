"""Runs of given bytes in texts, as exact strings, for operators that count words of their own kind."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

_BYTE = np.arange(256)
ASCII_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def letters_or_beyond_ascii(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of all characters beyond ASCII."""
    return (ASCII_LETTER | (_BYTE >= 128))[raw]


def latin_letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+00FF, whose first byte is 0xC3 and no other character's."""
    lead = raw == 0xC3
    inside = ASCII_LETTER[raw] | lead
    inside[1:] |= lead[:-1]
    return inside


def runs(texts: pa.Array, inside: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All maximal runs of bytes inside, A-Z lower-cased: the runs (as codes and the distinct ones) and the row that each is in.

    A null text has none. Runs are told apart by their bytes, not by a hash.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    values = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    mask = inside(raw)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    edges = offsets[(offsets < len(raw))]
    first[edges] = mask[edges]
    start = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(mask)])
    bounds = np.concatenate([kept[start], kept[-1:]]).astype(np.int64)
    data = _LOWER[raw[mask]]
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
    return found.dictionary_encode(), np.searchsorted(offsets, start, side="right") - 1


def counted(codes: np.ndarray, rows: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code), and how often each stands."""
    keys, n = np.unique(rows.astype(np.int64) * max(1, n_codes) + codes, return_counts=True)
    return keys // max(1, n_codes), keys % max(1, n_codes), n
