"""Words and word n-grams of whole texts as 64-bit hashes, vectorised over Arrow string buffers.

A word is a maximal run of digits, letters a-z (A-Z are lower-cased first) and characters beyond ASCII:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  UTF-8 keeps every byte of a character beyond ASCII at 0x80 or above,
so the split works on bytes.  A word's hash is a polynomial over random byte values modulo 2**64, finalised; texts are
taken in slices of about a quarter of a megabyte, so that memory stays bounded however long they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_b = np.arange(256)
_lower = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint64)
IS_WORD = ((_lower >= 48) & (_lower <= 57)) | ((_lower >= 97) & (_lower <= 122)) | (_lower >= 128)
VALUE = mix((_lower + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the base and of its inverse."""
    if not _tables or len(_tables[0]) <= n:
        size = max(n, SLICE) + 1
        _tables[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables[0], _tables[1]


class Words(NamedTuple):
    """Words of documents ``first .. first+len(at)-2`` of a batch: hashes, byte spans in ``data``, where each document's words begin."""

    first: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    data: np.ndarray
    sums: np.ndarray | None

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.at[i] : self.at[i + 1]]

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than n bytes, by place, and the hashes of their first n bytes."""
        which = np.flatnonzero(self.ends - self.starts > n)
        s = self.starts[which]
        return which, mix((self.sums[s + n] - self.sums[s]) * powers(int(len(self.data)))[1][s] + np.uint64(n))


def _words(data: np.ndarray, bounds: np.ndarray, first: int) -> Words:
    word = IS_WORD[data]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(first, hashes, starts, ends, np.searchsorted(starts, bounds), data, sums)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its values; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def words(column: pa.Array, whole: bool = True) -> Iterator[Words]:
    """Words of each document, some documents at a time; a document longer than a slice comes alone.

    ``whole`` joins the slices of a long document (its ``sums`` and ``data`` are then absent); otherwise each slice comes as a
    part of the document, and ``first`` repeats.
    """
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= SLICE or j > i + 1:
            yield _words(data[lo:hi], offsets[i : j + 1] - lo, i)
        else:
            parts = []
            while lo < hi:
                end = min(hi, lo + SLICE)
                while end < hi and IS_WORD[data[end - 1]] and IS_WORD[data[end]]:  # never inside a word
                    back = np.flatnonzero(~IS_WORD[data[lo:end]])
                    if len(back):
                        end = lo + int(back[-1]) + 1
                        break
                    end = min(hi, end + SLICE)
                part = _words(data[lo:end], np.array([0, end - lo]), i)
                if whole:
                    parts.append((part.hashes, part.starts + (lo - int(offsets[i])), part.ends + (lo - int(offsets[i]))))
                else:
                    yield part
                lo = end
            if whole:
                h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield Words(i, h, s, e, np.array([0, len(h)]), data[offsets[i] : offsets[j]], None)
        i = j


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words each, for each place where k words follow (those across two documents included)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))


def inside(at: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of the first n places, whether k words from there lie in one document."""
    ends = np.repeat(at[1:], np.diff(at))[:n]
    return np.arange(at[0], at[0] + n) + k <= ends


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of one document; all its words are one shingle if there are fewer."""
    return np.unique(grams(hashes, min(k, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat).cast(kind))
