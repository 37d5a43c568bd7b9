"""Vectorised word splitting and hashing of Arrow text columns (numpy only).

Words are maximal runs of bytes other than space and \\x09-\\x0D, found for a whole
batch at once on the UTF-8 buffer; none of it is per-word Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes handled at once; longer texts are still handled whole.
SLAB = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string array; a null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch: `start`, `end` (bytes), `doc` (row), `hash`; `first[i]:first[i+1]` are those of row i."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False, hashed: bool = True):
        rows = len(at) - 1
        white = _WHITE[raw]
        ahead, behind = np.empty(len(raw), bool), np.empty(len(raw), bool)
        if len(raw):
            ahead[0], ahead[1:] = True, white[:-1]
            behind[-1], behind[:-1] = True, white[1:]
            full = at[:-1] < at[1:]
            ahead[at[:-1][full]] = True
            behind[at[1:][full] - 1] = True
        self.start = np.flatnonzero(~white & ahead)
        self.end = np.flatnonzero(~white & behind) + 1
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        self.hash = self._hash(_LOWER[raw] if lower else raw) if hashed else None

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all words, about SLAB bytes at a time, so memory does not grow with a text by much."""
        out, k = np.empty(len(self.start), np.uint64), 0
        with np.errstate(over="ignore"):
            while k < len(out):
                base = self.start[k]
                m = max(k + 1, int(np.searchsorted(self.end, base + SLAB, "right")))
                start, end = self.start[k:m] - base, self.end[k:m] - base
                part = raw[base : base + end[-1]]
                power = np.full(len(part) + 1, _BASE)
                power[0] = 1
                np.multiply.accumulate(power, out=power)
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
                power[1:] = _INVERSE
                np.multiply.accumulate(power, out=power)
                out[k:m] = mix((total[end] - total[start]) * power[start] + (end - start).astype(np.uint64))
                k = m
        return out


def slabs(texts: pa.Array):
    """(first row, bytes, offsets) of consecutive rows, about SLAB bytes each."""
    raw, at = buffer_of(texts)
    rows, k = len(at) - 1, 0
    while k < rows:
        upto = max(k + 1, int(np.searchsorted(at, at[k] + SLAB, "right")) - 1)
        yield k, raw[at[k] : at[upto]], at[k : upto + 1] - at[k]
        k = upto


_STEP = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]


def shingle_sets(texts: pa.Array, width: int = 5):
    """Yields each row's sorted distinct shingle hashes (A-Z lower-cased).

    Fewer words than `width` make one shingle of all words; no word makes an empty set.
    """
    for _, raw, at in slabs(texts):
        w = Words(raw, at, lower=True)
        n = len(w.hash)
        with np.errstate(over="ignore"):
            if n >= width:
                sh = np.zeros(n - width + 1, np.uint64)
                for k in range(width):
                    sh += (w.hash[k : n - width + 1 + k] ^ _STEP[k % 7]) * _STEP[(k + 3) % 7] * np.uint64(2 * k + 1)
                    sh = (sh << np.uint64(13)) | (sh >> np.uint64(51))
                sh = mix(sh)
            for i in range(len(at) - 1):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if b - a >= width:
                    yield np.unique(sh[a : b - width + 1])
                elif b > a:
                    h = np.uint64(b - a)
                    for x in w.hash[a:b]:
                        h = mix((np.array([h]) ^ x) * _STEP[0])[0]
                    yield np.array([h], np.uint64)
                else:
                    yield np.zeros(0, np.uint64)
