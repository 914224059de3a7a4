"""The kernel over whole Arrow columns.

Characters are classed by table, segments are found and hashed as spans of
numpy arrays, and their pieces are gathered from one flat pool.  Python code runs
for each segment that a worker sees for the first time, and once for each text
where a limit cuts it.  The rules are those of :class:`~.kernel.Kernel`, which
fills the pool and takes the texts that hold added tokens.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import chars
from .kernel import CLEANUPS, Kernel

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters that are looked at together, and the longest segment that is told by its hash alone.
BLOCK, _LONG = 1 << 18, 64
#: Characters of a word, or of a token, that are matched for many words at once.
_SHORT = 32
_SLOTS = 16
#: Rows and ids beyond which a pool leaves what it didn't find again.
_ROWS, _IDS = 1 << 17, 1 << 20
_WHITE, _WORD, _SINGLE = 0, 1, 2


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x10001, _WORD, dtype=np.uint8)
    for ranges, kind in ((chars.WHITESPACE_RANGES, _WHITE), (chars.punctuation_ranges(), _SINGLE), (chars.IDEOGRAPH_RANGES, _SINGLE)):
        for a, b in ranges:
            out[a : b + 1] = kind
    return out


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def blocks(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range alone."""
    length = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    end, a = np.cumsum(length), 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


class Segments:
    """Spans of characters of some texts: starts, ends, first segment of each text, and the texts as code points."""

    __slots__ = ("points", "offsets", "start", "end", "first")

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        n = len(self.points)
        kind = _classes()[np.minimum(self.points, 0x10000)]
        word = kind == _WORD
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        begins, ends = kind != _WHITE, kind != _WHITE
        begins[1:] &= ~(word[1:] & word[:-1]) | edge[1:n]
        ends[:-1] &= ~(word[1:] & word[:-1]) | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the spans, by sums of powers."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        up, down = _powers(_BASE), _powers(_INVERSE)
        i = 0
        while i < len(out):
            low = int(self.start[i])
            j = int(np.searchsorted(self.start, low + BLOCK - _LONG, side="left"))
            high = min(int(self.end[j - 1]), low + BLOCK)
            total = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum((self.points[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
            s, e = self.start[i:j] - low, np.minimum(self.end[i:j] - low, high - low)
            out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))

    def texts(self, change: Callable[[str], str]) -> pa.Array:
        """All spans as strings; ``change`` keeps the number of characters."""
        size = self.end - self.start
        end = np.cumsum(size)
        at = np.repeat(self.start - end + size, size) + np.arange(int(size.sum()))
        data = change(self.points[at].tobytes().decode("utf-32-le"))
        points = np.frombuffer(data.encode("utf-32-le"), dtype=np.uint32)
        width = np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))
        offsets = np.concatenate(([0], width[end - 1])).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data.encode())])

    def text(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


class Pool:
    """Pieces of all segments that were seen, in one array, and a table from hashes to them.

    ``hashes`` is sorted and has its rows in ``by_hash``; the slots are a shortcut to it.
    """

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self._reset()

    def _reset(self) -> None:
        self.held, self.used = np.zeros(1 << 16, np.int64), 0
        self.begin, self.size, self.attempt = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.again = np.zeros(1 << 12, bool)
        self.rows, self.hashes, self.by_hash = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.slot_hash, self.slot_row = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int64)
        model = self.kernel.model
        self.add([((model.cls[1],), ()), ((model.sep[1],), ())])

    def _shrink(self) -> None:
        """Begin anew with the segments that were found again since the last time; with none, if they fill half of the pool."""
        mark = self.again[self.by_hash]
        hashes, row = self.hashes[mark], self.by_hash[mark]
        size, attempt = self.size[row], self.attempt[row]
        few = len(row) <= _ROWS // 2 and int(size.sum()) <= _IDS // 2
        flat = self.gather(row) if few else None
        self._reset()
        if few:
            self.hashes, self.by_hash = hashes, self._extend(size, attempt, flat)
            slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
            self.slot_hash[slot], self.slot_row[slot] = hashes, self.by_hash

    def add(self, made: list[tuple]) -> np.ndarray:
        """New rows for (pieces, pieces of failed attempts) each."""
        size = np.fromiter((len(pieces) for pieces, _ in made), np.int64, len(made))
        attempt = np.fromiter((max(map(len, attempts), default=0) for _, attempts in made), np.int64, len(made))
        flat = np.fromiter((i for pieces, _ in made for i in pieces), np.int64, int(size.sum()))
        return self._extend(size, attempt, flat)

    def _extend(self, size: np.ndarray, attempt: np.ndarray, flat: np.ndarray) -> np.ndarray:
        rows = np.arange(self.rows, self.rows + len(size))
        self.held = self._put(self.held, self.used, flat)
        self.begin = self._put(self.begin, self.rows, self.used + np.cumsum(size) - size)
        self.size, self.attempt = self._put(self.size, self.rows, size), self._put(self.attempt, self.rows, attempt)
        self.again = self._put(self.again, self.rows, np.zeros(len(size), bool))
        self.used, self.rows = self.used + len(flat), self.rows + len(size)
        return rows

    def _make(self, segments: Segments, which: np.ndarray) -> np.ndarray:
        """Rows for segments that are new: short words all at once, through all fallbacks, others one by one."""
        rows, size, attempt = np.full(len(which), -1, np.int64), np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        model, make = self.kernel.model, self.kernel.make
        words = [self.kernel.cased(segments.text(i)) for i in which.tolist()]
        live = [k for k, w in enumerate(words) if len(w) <= _SHORT and chars.drop_controls(w) == w]
        alone = sorted(set(range(len(words))) - set(live))
        while live:
            later = []
            for a in range(0, len(live), 1 << 12):
                some = np.array(live[a : a + (1 << 12)])
                made, whole = self._greedy([words[k] for k in some.tolist()])
                done = some[whole]
                size[done] = (made[whole] >= 0).sum(axis=1)
                rows[done] = self._extend(size[done], attempt[done], made[whole][made[whole] >= 0])
                lost = some[~whole]
                attempt[lost] = np.maximum(attempt[lost], (made[~whole] >= 0).sum(axis=1))
                for k in lost.tolist():
                    word = words[k]
                    if not unicodedata.is_normalized(model.form, word):
                        words[k] = unicodedata.normalize(model.form, word)
                    elif model.strip_accents and not word.isascii() and (bare := chars.strip_marks(word, model.form)) != word:
                        words[k] = bare
                    else:
                        rows[k] = self._extend(np.ones(1, np.int64), attempt[k : k + 1], np.array([model.unk[1]]))[0]
                        continue
                    # a fallback may be longer, or bring a control to light
                    (later if len(words[k]) <= _SHORT and chars.drop_controls(words[k]) == words[k] else alone).append(k)
            live = later
        if alone:
            rows[alone] = self.add([make(segments.text(int(which[k]))) for k in alone])
        return rows

    def _greedy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces filled up with -1, whether they make up the word): longest matches from the left of some short words."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(length.max(initial=1))
        grid = np.zeros((len(words), width), np.uint64)
        grid[np.arange(width) < length[:, None]] = points
        up, down = _powers(_BASE), _powers(_INVERSE)
        total = np.zeros((len(words), width + 1), np.uint64)
        np.cumsum((grid + np.uint64(1)) * up[:width], axis=1, out=total[:, 1:])
        live, at, steps = np.flatnonzero(length), np.zeros(len(words), np.int64), []
        while len(live):
            step, wait = np.full(len(words), -1, np.int64), live
            for size, known, ids in self.tables[len(steps) > 0]:
                fits = wait[at[wait] + size <= length[wait]]
                if len(fits):
                    h = (total[fits, at[fits] + size] - total[fits, at[fits]]) * down[at[fits]]
                    found = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[found] == h
                    step[fits[hit]] = ids[found[hit]]
                    at[fits[hit]] += size
                    wait = wait[step[wait] < 0]
            steps.append(step)
            live = live[(step[live] >= 0) & (at[live] < length[live])]
        made = np.stack(steps, axis=1) if steps else np.zeros((len(words), 0), np.int64)
        return made, (at == length) & (length > 0)

    @cached_property
    def tables(self) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For prefixes and suffixes: (length, sorted hashes, ids) of the short tokens, longest first."""
        out = []
        for tokens in (self.kernel.model.prefixes, self.kernel.model.suffixes):
            by_size: dict[int, list[tuple[int, int]]] = {}
            for token, number in tokens.items():
                if 0 < len(token) <= _SHORT:
                    by_size.setdefault(len(token), []).append((sum((ord(c) + 1) * pow(_BASE, k, 1 << 64) for k, c in enumerate(token)) % (1 << 64), number))
            found = sorted(by_size.items(), reverse=True)
            out.append([(size, np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int64)) for size, x in found])
        return out

    @staticmethod
    def _put(held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        if at + len(new) > len(held):
            held = np.concatenate((held, np.zeros(max(len(held), len(new)), held.dtype)))
        held[at : at + len(new)] = new
        return held

    def find(self, segments: Segments) -> np.ndarray:
        """The row of every segment."""
        if self.rows > _ROWS or self.used > _IDS:
            self._shrink()
        h = segments.hashes()
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        row = np.where(self.slot_hash[slot] == h, self.slot_row[slot], -1)
        long = segments.end - segments.start > _LONG
        row[long] = -1
        self.again[row[row >= 0]] = True
        missing = np.flatnonzero((row < 0) & ~long)
        if len(missing):
            new, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            found, where = np.full(len(new), -1, np.int64), np.searchsorted(self.hashes, new)
            held = np.flatnonzero(where < len(self.hashes))
            held = held[self.hashes[where[held]] == new[held]]
            found[held] = self.by_hash[where[held]]
            self.again[found[held]] = True
            fresh = np.flatnonzero(found < 0)
            found[fresh] = self._make(segments, missing[at[fresh]])
            self.hashes = np.insert(self.hashes, where[fresh], new[fresh])
            self.by_hash = np.insert(self.by_hash, where[fresh], found[fresh])
            slot = (new >> np.uint64(64 - _SLOTS)).astype(np.int64)
            self.slot_hash[slot], self.slot_row[slot] = new, found
            row[missing] = found[back]
        if long.any():
            row[long] = self.add([self.kernel.memo[segments.text(i)] for i in np.flatnonzero(long).tolist()])
        return row

    def gather(self, row: np.ndarray) -> np.ndarray:
        """The pieces of some rows, one after the other."""
        size = self.size[row]
        end = np.cumsum(size)
        at = np.repeat(self.begin[row] - end + size, size)
        at += np.arange(len(at))
        return self.held[at]


class VectorKernel:
    """Whole columns for one kernel."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.pool = kernel, Pool(kernel)
        self._decoder: tuple | None = None

    def _plain(self, texts: list[str]) -> np.ndarray:
        """Which texts hold no added token."""
        exact, pattern = [t for t in self.kernel.exact if t], self.kernel.folded_pattern
        out = np.ones(len(texts), dtype=bool)
        for token in exact:
            out &= np.fromiter((token not in t for t in texts), dtype=bool, count=len(texts))
        if pattern is not None:
            out &= np.fromiter((pattern.search(t) is None for t in texts), dtype=bool, count=len(texts))
        return out

    def encode(self, column: pa.Array, limit: int | None) -> pa.ListArray:
        """list<int64> of CLS, pieces, SEP for each text; null for null."""
        ids, sizes = [np.zeros(0, np.int64)], np.zeros(len(column), np.int64)
        for a, b in blocks(column, BLOCK):
            made, size = self._encode([t or "" for t in column.slice(a, b - a).to_pylist()], limit)
            ids.append(made)
            sizes[a:b] = size
        null = np.asarray(column.is_null())
        if null.any():
            keep = np.repeat(~null, sizes)
            ids = [np.concatenate(ids)[keep]]
            sizes[null] = 0
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids)), mask=pa.array(null) if null.any() else None)

    def _encode(self, texts: list[str], limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their numbers)."""
        texts = [self.kernel.prepare(t) for t in texts] if self.kernel.model.form != "NFD" else texts
        plain = self._plain(texts)
        cut = None if limit is None else 8 * limit
        short = [t[:cut] if p else "" for t, p in zip(texts, plain.tolist(), strict=True)]
        segments = Segments(short)
        row, n = self.pool.find(segments), len(texts)
        first, last = segments.first[:-1], segments.first[1:].copy()
        alone = np.flatnonzero(~plain)
        tails: list[tuple[int, ...]] = [()] * n
        if limit is not None:
            size = self.pool.size[row]
            before = np.concatenate(([0], np.cumsum(size)))
            text = np.repeat(np.arange(n), last - first)
            room = limit - 1 - (before[:-1] - before[first][text])
            full = np.flatnonzero((size >= room - 1) | (self.pool.attempt[row] >= room) | (room <= 1))
            stop = np.searchsorted(full, first)
            ended = (stop < len(full)) & (full[np.minimum(stop, len(full) - 1)] < last) if len(full) else np.zeros(n, dtype=bool)
            clipped = np.fromiter((len(s) < len(t) for s, t in zip(short, texts, strict=True)), dtype=bool, count=n) & plain
            for k in np.flatnonzero(ended).tolist():
                i = int(full[stop[k]])
                # a segment at the end of a clipped text may be longer than it seems
                if clipped[k] and segments.end[i] == segments.offsets[k + 1]:
                    continue
                last[k], clipped[k] = i, False
                if room[i] > 1:
                    tails[k] = self.kernel.pieces(segments.text(i), int(room[i]))[: int(room[i]) - 1]
            alone = np.concatenate((alone, np.flatnonzero(clipped)))
        kept = last - first
        kept[alone] = 0
        total = kept + 2
        rows = np.ones(int(total.sum()), dtype=np.int64)
        begin = np.cumsum(total) - total
        rows[begin] = 0
        at = np.repeat(first - begin - 1, kept)
        inner = np.repeat(begin + 1, kept) + np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
        rows[inner] = row[inner + at]
        where = [k for k in range(n) if tails[k]]
        if where:
            rows = np.insert(rows, (begin + total - 1)[where], self.pool.add([(tails[k], ()) for k in where]))
            total[where] += 1
        ids = self.pool.gather(rows)
        sums = np.concatenate(([0], np.cumsum(self.pool.size[rows])))
        ends = np.cumsum(total)
        sizes = sums[ends] - sums[ends - total]
        if len(alone):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k in alone.tolist():
                parts[k] = np.array(self.kernel.encode_all(texts[k]) if limit is None else self.kernel.encode(texts[k], limit), np.int64)
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, sizes

    def segments(self, column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(segments of each text, all segments as they are looked up, their starts); none for null."""
        texts = [self.kernel.prepare(t or "") for t in column.to_pylist()]
        plain = self._plain(texts)
        found = Segments([t if p else "" for t, p in zip(texts, plain.tolist(), strict=True)])
        count = np.diff(found.first)
        text = found.texts(chars.simple_lower if self.kernel.model.lowercase else str)
        start = found.start - np.repeat(found.offsets[:-1], count)
        alone = np.flatnonzero(~plain).tolist()
        if not alone:
            return count, text, pa.array(start, pa.int32())
        own = {k: self.kernel.segments(texts[k]) for k in alone}
        # texts with added tokens go where they were left out
        pieces, starts, at = [], [], 0
        for k in alone:
            end = int(found.first[k])
            pieces += [text.slice(at, end - at), pa.array([s for s, _ in own[k]], pa.string())]
            starts += [start[at:end], np.array([x for _, x in own[k]], np.int64)]
            count[k], at = len(own[k]), end
        text = pa.concat_arrays([*pieces, text.slice(at)])
        return count, text, pa.array(np.concatenate((*starts, start[at:])), pa.int32())

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segments, pieces without CLS and SEP, unknown ones among them) of each text; zeros for null."""
        out = np.zeros((3, len(column)), np.int64)
        for a, b in blocks(column, BLOCK):
            texts = [self.kernel.prepare(t or "") for t in column.slice(a, b - a).to_pylist()]
            plain, unknown = self._plain(texts), self.kernel.model.unk[1]
            segments = Segments([t if p else "" for t, p in zip(texts, plain.tolist(), strict=True)])
            row = self.pool.find(segments)
            size = self.pool.size[row]
            pieces = np.concatenate(([0], np.cumsum(size)))
            lost = np.concatenate(([0], np.cumsum(self.pool.gather(row) == unknown)))
            bounds = segments.first
            out[:, a:b] = np.diff(bounds), np.diff(pieces[bounds]), np.diff(lost[pieces[bounds]])
            for k in np.flatnonzero(~plain).tolist():
                ids, words = self.kernel.encode_all(texts[k])[1:-1], sum(1 for _ in self.kernel.pattern.finditer(texts[k]))
                out[:, a + k] = words, len(ids), ids.count(unknown)
        return out[0], out[1], out[2]

    def chunks(self, column: pa.Array, size: int, stride: int) -> Iterator[tuple[str | None, list[tuple[int, int | None, np.ndarray, bool]]]]:
        """(prepared text, its chunks as :meth:`Kernel.chunks` gives them) of each text; no chunks for null."""
        for a, b in blocks(column, BLOCK):
            given = column.slice(a, b - a).to_pylist()
            texts = [None if t is None else self.kernel.prepare(t) for t in given]
            plain = self._plain([t or "" for t in texts]).tolist()
            segments = Segments([t if t and p else "" for t, p in zip(texts, plain, strict=True)])
            row = self.pool.find(segments)
            size_of = self.pool.size[row]
            before = np.concatenate(([0], np.cumsum(size_of)))
            # how far a word must reach for a chunk to end with it, by its pieces or by those of a failed attempt
            reach = before[:-1] + np.maximum(size_of + 1, self.pool.attempt[row])
            held = before, reach, np.maximum.accumulate(reach) if len(reach) else reach, self.pool.gather(row), self.pool.attempt[row]
            for k, text in enumerate(texts):
                if text is None:
                    yield None, []
                elif plain[k]:
                    yield text, self._chunks(segments, k, held, size, stride)
                else:
                    yield text, [(x, y, np.array(ids, np.int64), lost) for x, y, ids, lost in self.kernel.chunks(text, size, stride)]

    def _chunks(self, segments: Segments, text: int, held: tuple, size: int, stride: int) -> list[tuple[int, int | None, np.ndarray, bool]]:
        before, reach, furthest, flat, attempt = held
        model, zero = self.kernel.model, int(segments.offsets[text])
        length, end = int(segments.offsets[text + 1]) - zero, int(segments.first[text + 1])
        cls, sep = np.array([model.cls[1]]), np.array([model.sep[1]])
        out, at, offset, tail = [], int(segments.first[text]), 0, cls[:0]
        while True:
            target = before[at] + size - len(tail) - 1
            k = at + int(np.searchsorted(furthest[at:end], target))
            while k < end and reach[k] < target:
                k += 1
            ids, following, resume, lost = [cls, tail, flat[before[at] : before[k]]], None, None, False
            if k < end:
                room = int(target - before[k])
                # only a word of which an attempt fills the room is matched again, so the memo doesn't fill with words at limits
                got = flat[before[k] : before[k + 1]][:room] if attempt[k] < room else np.array(self.kernel.pieces(segments.text(k), room), np.int64)
                start = int(segments.start[k]) - zero
                if len(got) < room:
                    ids.append(got)
                    if length > int(segments.end[k]) - zero:
                        following, resume = start, k
                elif before[k] == before[at]:
                    ids.append(got[: room - 1])
                    lost = True
                else:
                    following, resume = start, k
                    if stride == 0:
                        ids.append(got[: room - 1])
            if following is not None and following <= offset and resume == at:
                resume += 1
                following = int(segments.end[at]) - zero if resume < end else None
            ids = np.concatenate(ids)
            tail = ids[max(1, len(ids) - stride) :] if stride else tail
            out.append((offset, following, np.concatenate((ids, sep)), lost))
            if following is None:
                return out
            at, offset = resume, following

    def decode(self, column: pa.Array, strict: bool = False) -> pa.Array:
        """Texts of id lists; an unknown first id gives null, or an error if ``strict``."""
        ids, shown, opening = self._tables()
        lists = column.cast(pa.list_(pa.int64()))
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
        flat = np.asarray(lists.flatten())
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        at = np.where(ids[at] == flat, at, len(ids))
        end = np.cumsum(size)
        first = (end - size)[size > 0]
        lost = np.zeros(len(size), dtype=bool)
        lost[size > 0] = at[first] == len(ids)
        if strict and lost.any():
            raise KeyError(f"the vocabulary has no token {flat[(end - size)[lost][0]]}")
        at[first] += len(ids) + 1
        offsets = pa.array(np.concatenate(([0], end)).astype(np.int32), pa.int32())
        null = np.asarray(column.is_null()) | lost
        out = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays([shown, opening]).take(pa.array(at))), "")
        for before, after in CLEANUPS if self.kernel.model.cleanup else ():
            out = pc.replace_substring(out, before, after)
        return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out)

    def _tables(self) -> tuple:
        """Sorted ids, and what each shows behind others and at the beginning; one more for unknown ids, which show nothing."""
        if self._decoder is None:
            prefixes, suffixes = self.kernel.names()
            ids, clean = sorted({*prefixes, *suffixes}), self.kernel.model.cleanup
            inner = lambda t: t if clean and t in (".", "?", "!", ",") else " " + t
            shown = [(inner(prefixes[i]) if i in prefixes else "") + suffixes.get(i, "") for i in ids]
            opening = [prefixes[i] if i in prefixes else self.kernel.model.decoder_prefix + suffixes[i] for i in ids]
            self._decoder = np.array(ids, np.int64), pa.array([*shown, ""]), pa.array([*opening, ""])
        return self._decoder
