"""Vectorised text kernels over Arrow string columns.

Every corpus-wide Python pass of this subpackage runs inside ``mapInArrow`` and
works on the raw UTF-8 bytes of a whole slice of documents at once with numpy.
Python runs for each match of the secret scan and each paragraph of the licence
scan, and for nothing else by row or token.

Tokens are maximal runs of letters and digits after lower-casing.  Bytes of
non-ASCII characters count as letters, except the General Punctuation and CJK
punctuation blocks, the no-break space and the Latin-1 signs U+00A1..U+00BF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 18
_LONG = 1 << 16
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 18

_ALNUM = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _ALNUM[_c] = True
_ALNUM[0x80:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base & 0xFFFFFFFFFFFFFFFF)
    return np.multiply.accumulate(out)


_POW = _powers(_P, _BLOCK + _LONG + 1)
_IPOW = _powers(_PINV, _BLOCK + _LONG + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bijection on uint64 arrays (multiply / xor-shift avalanche)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` holding at most ``limit`` bytes of text and SLICE_ROWS rows each; a longer text is a range alone."""
    n = len(column)
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    end = np.cumsum(size)
    a = 0
    while a < n:
        base = end[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(end, base + limit, side="right")))
        b = min(b, a + SLICE_ROWS)
        yield a, b
        a = b


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 byte offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _letters(data: np.ndarray) -> np.ndarray:
    keep = _ALNUM[data]
    lead = np.flatnonzero((data == 0xE2) | (data == 0xE3) | (data == 0xC2))
    if len(lead):
        lead = lead[lead + 2 < len(data) + (data[lead] == 0xC2)]
        first, second = data[lead], data[lead + 1]
        wide = lead[((first == 0xE2) & (second <= 0x81)) | ((first == 0xE3) & (second == 0x80))]
        narrow = lead[(first == 0xC2) & (second >= 0xA0)]
        for shift in range(3):
            keep[wide + shift] = False
        for shift in range(2):
            keep[narrow + shift] = False
    return keep


class Tokens:
    """Tokens of several documents: 64-bit hashes, byte spans, and the first token of each document."""

    __slots__ = ("hash", "start", "end", "doc", "data", "offsets")

    def __init__(self, hashes, start, end, doc, data, offsets):
        self.hash, self.start, self.end, self.doc, self.data, self.offsets = hashes, start, end, doc, data, offsets


def spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte positions of the maximal kept runs, none of which crosses a row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    begins[edge] |= keep[edge]
    ends = np.empty(n, dtype=bool)
    ends[:-1] = keep[:-1] & ~keep[1:]
    ends[-1] = keep[-1]
    before = edge[edge > 0] - 1
    ends[before] |= keep[before]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, through prefix sums over blocks of the data."""
    out = np.empty(len(start), dtype=np.uint64)
    i, n = 0, len(start)
    while i < n:
        low = int(start[i])
        if int(end[i]) - low > _LONG:
            out[i] = xxhash.xxh64_intdigest(data[low : int(end[i])].tobytes())
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(start, low + _BLOCK, side="left")))
        wide = np.flatnonzero(end[i:j] - start[i:j] > _LONG)
        if len(wide):
            j = i + int(wide[0])
        high = int(end[j - 1])
        total = np.empty(high - low + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _POW[: high - low], out=total[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (total[e] - total[s]) * _IPOW[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def tokenize(column: pa.Array, lower: bool = True) -> Tokens:
    """Word tokens of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = raw(pc.utf8_lower(column) if lower else column)
    start, end = spans(data, offsets, _letters(data))
    return Tokens(hash_spans(data, start, end), start, end, np.searchsorted(start, offsets, side="left"), data, offsets)


def ngrams(tok: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the token n-grams within rows, and the n+1 offsets of the rows among them."""
    count = np.maximum(np.diff(tok.doc) - (n - 1), 0)
    offsets = np.concatenate(([0], np.cumsum(count)))
    if n == 1:
        return tok.hash, offsets
    total = int(offsets[-1])
    if total == 0:
        return np.zeros(0, np.uint64), offsets
    full = tok.hash[: len(tok.hash) - n + 1].copy()
    for k in range(1, n):
        full *= np.uint64(0xD6E8FEB86659FD93)
        full += tok.hash[k : len(tok.hash) - n + 1 + k]
    if len(tok.doc) > 2:
        valid = np.zeros(len(full) + 1, dtype=np.int32)
        some = count > 0
        np.add.at(valid, tok.doc[:-1][some], 1)
        np.add.at(valid, (tok.doc[:-1] + count)[some], -1)
        full = full[np.cumsum(valid[:-1]) > 0]
    return mix(full), offsets


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, with zero for empty ones."""
    n = len(offsets) - 1
    out = np.zeros((n, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some], axis=0, dtype=out.dtype)
    return out
