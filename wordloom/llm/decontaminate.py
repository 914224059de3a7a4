"""Benchmark decontamination by spaced-seed hashing.

Masks sample token positions of a window and ignore the others, so a window
still hits after substitutions at ignored positions.  They are chosen by item
length so that wherever enough tokens agree for a leak, some mask hits: no
pattern of substitutions that ``overlap`` allows is missed.  All masked windows
of the benchmark items make a hash index; every window of every document is
looked up in it.  Each hit names an alignment of an item with a document, which
is verified token by token: an item is leaked where some window of
``min(item tokens, window)`` aligned tokens agrees in at least ``overlap``.

The join of document windows with the index has two forms of equal results.  A
benchmark of at most ``broadcast_bytes`` of text makes an index that every task
holds.  A larger one stays a table: the windows of the documents that pass a
sieve of fixed size are shuffled and joined with it by hash, each with the
tokens around it, so that a joined pair is verified where it is; the documents
are still read once, and no part of the benchmark passes through the driver.

Defined results: every item with a word is searched; one of one or two words is
found where they stand as they are.  Null or empty texts match nothing.
Repeated items count once; repeated document rows repeat their matches.  Null
ids are carried; doc_id and item_id may have any type.  Other columns are
untouched, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from ..runtime import map_batches
from . import kernels as K
from .tables import cut, fingerprint, spare

#: Most positions that a seed compares, and most seeds for one item length.
WEIGHT, SEEDS = 6, 10
#: Alignments, and item tokens compared at a time, that bound the memory of a search.
HITS, COMPARED = 1 << 21, 1 << 21


@dataclass(frozen=True)
class LeakConfig:
    """``broadcast_bytes``: benchmark text whose index is broadcast; ``broadcast_leaks``: texts to drop that are."""

    window: int = 30
    overlap: float = 0.6
    broadcast_bytes: int = 4 << 20
    broadcast_leaks: int = 1 << 20

    def need(self, width: int) -> int:
        """Tokens of a window that must agree."""
        return max(1, ceil(self.overlap * width - 1e-9))

    def seeds(self, size: int) -> tuple[tuple[int, ...], ...]:
        width = min(size, self.window)
        return seeds(width, self.need(width))


@lru_cache(maxsize=1024)
def seeds(width: int, need: int) -> tuple[tuple[int, ...], ...]:
    """The heaviest seeds of which one hits wherever at least ``need`` of ``width`` positions agree.

    All choices of ``weight`` positions within ``span`` are such seeds if fewer than ``weight`` agreeing positions
    in every block of ``span`` would add up to less than ``need``.
    """
    for weight in range(min(WEIGHT, need), 1, -1):
        for span in range(weight, width + 1):
            blocks, rest = divmod(width, span)
            if comb(span - 1, weight - 1) <= SEEDS and blocks * (weight - 1) + min(rest, weight - 1) < need:
                return tuple((0, *places) for places in combinations(range(1, span), weight - 1))
    return ((0,),)


def masked(tokens: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Hash of the compared positions of the window at every token."""
    n = len(tokens) - seed[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(seed), dtype=np.uint64)
    for place in seed:
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += tokens[place : place + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h


class SeedIndex:
    """Masked window hashes of some benchmark items, sorted, behind a bitmap of their high bits."""

    def __init__(self, items: list[tuple[int | None, str]], config: LeakConfig):
        self.config = config
        tok = K.tokenize(pa.array([t for _, t in items], pa.string()))
        size = np.diff(tok.doc)
        used = size > 0
        self.ids = [i for i, _ in items]
        self.tokens, self.first, self.size = tok.hash, tok.doc[:-1], size
        owner = np.repeat(np.arange(len(items)), size)
        sizes = defaultdict(list)
        for n in sorted(set(size[used].tolist())):
            for seed in config.seeds(n):
                sizes[seed].append(n)
        self.tables = []
        for seed, of in sorted(sizes.items()):
            which = np.isin(size, of)
            h = masked(tok.hash, seed)
            if len(h) == 0:
                continue
            at = np.arange(len(h))
            at = at[(owner[at] == owner[at + seed[-1]]) & used[owner[at]] & which[owner[at]]]
            if len(at) == 0:
                continue
            h = h[at]
            by = np.argsort(h, kind="stable")
            bits = min(26, max(12, int(np.ceil(np.log2(len(h)))) + 6))
            bitmap = np.zeros(1 << bits, dtype=bool)
            bitmap[h >> np.uint64(64 - bits)] = True
            self.tables.append((seed, h[by], owner[at][by], at[by] - self.first[owner[at]][by], bits, bitmap))

    def find(self, tok: K.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, agreeing tokens, compared tokens): the best verified alignment of each pair."""
        found = [x for both in self._alignments(tok) for x in self._verified(tok, both)]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        row, item, same, of = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((-same / np.maximum(of, 1), item, row))
        row, item, same, of = row[by], item[by], same[by], of[by]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return row[new], item[new], same[new], of[new]

    def _alignments(self, tok: K.Tokens) -> Iterator[np.ndarray]:
        """Distinct alignments that some seed hits, as (place + tokens) * items + item; some come again in a later array."""
        n, shift = len(tok.hash), np.int64(len(self.ids))
        held, total = [], 0
        for seed, keys, owner, at, bits, bitmap in self.tables:
            h = masked(tok.hash, seed)
            live = np.flatnonzero(bitmap[h >> np.uint64(64 - bits)])
            low = np.searchsorted(keys, h[live], side="left")
            count = np.searchsorted(keys, h[live], side="right") - low
            live, low, count = live[count > 0], low[count > 0], count[count > 0]
            for i, j in _runs(count, HITS):
                hit = np.repeat(live[i:j], count[i:j])
                entry = np.repeat(low[i:j] - np.cumsum(count[i:j]) + count[i:j], count[i:j]) + np.arange(len(hit))
                held.append((hit - at[entry] + n) * shift + owner[entry])
                total += len(hit)
                if total >= HITS:
                    yield np.unique(np.concatenate(held))
                    held, total = [], 0
        if held:
            yield np.unique(np.concatenate(held))

    def _verified(self, tok: K.Tokens, both: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        shift = np.int64(len(self.ids))
        place, item = both // shift - len(tok.hash), both % shift
        for i, j in _runs(self.size[item], COMPARED):
            yield self._verify(tok, place[i:j], item[i:j])

    def _verify(self, tok: K.Tokens, place: np.ndarray, item: np.ndarray):
        """Slide a window over each alignment; the row is the one that holds most of it, tried for every row it touches."""
        config = self.config
        size = self.size[item]
        first = np.searchsorted(tok.doc, np.clip(place, 0, None), side="right") - 1
        last = np.searchsorted(tok.doc, np.clip(place + size - 1, 0, max(len(tok.hash) - 1, 0)), side="right") - 1
        rows = last - first + 1
        which = np.repeat(np.arange(len(item)), rows)
        row = np.repeat(first, rows) + np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)
        place, item, size = place[which], item[which], size[which]
        pair = np.repeat(np.arange(len(item)), size)
        start = np.cumsum(size) - size
        k = np.arange(len(pair)) - start[pair]
        at = place[pair] + k
        inside = (at >= tok.doc[row[pair]]) & (at < tok.doc[row[pair] + 1])
        at = np.where(inside, at, 0)
        same = inside & (tok.hash[at] == self.tokens[self.first[item[pair]] + k])
        total = np.concatenate(([0], np.cumsum(same)))
        width = np.minimum(size, config.window)
        ends = k + 1 >= width[pair]
        score = np.where(ends, total[1:] - total[np.maximum(np.arange(len(pair)) + 1 - width[pair], 0)], 0)
        best = np.maximum.reduceat(score, start) if len(start) else score
        good = best >= np.ceil(config.overlap * width - 1e-9)
        return row[good], item[good], best[good], width[good]


def _runs(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges ``[i, j)`` of at most ``limit`` in sum; a larger one is a range alone."""
    end, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + limit, side="right")))
        yield i, j
        i = j


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()


def _index(items: DataFrame, config: LeakConfig) -> SeedIndex | None:
    """The index of a benchmark within the bound; None beyond it."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > config.broadcast_bytes:
        return None
    rows = sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (r[0] is None, r))
    return SeedIndex(rows, config)


#: Bits of a hash by which the sieve knows it: 2^18 words of 64 bits.
_SIEVE = 24
_WINDOWS = 1 << 15


def _around(tok: K.Tokens, at: np.ndarray, reach: int, outside: int) -> np.ndarray:
    """The tokens from ``reach`` before to ``reach`` behind some tokens, of the same row."""
    row = np.searchsorted(tok.doc, at, side="right") - 1
    place = at[:, None] + np.arange(-reach, reach + 1)
    inside = (place >= tok.doc[row][:, None]) & (place < tok.doc[row + 1][:, None])
    return np.where(inside, tok.hash[np.clip(place, 0, len(tok.hash) - 1)], np.uint64(outside))


def _hits(tok: K.Tokens, used: list[tuple[int, ...]], allowed: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, first tokens) of the masked windows that don't cross a row and are allowed; seeds differ in their hashes."""
    row = np.repeat(np.arange(len(tok.doc) - 1), np.diff(tok.doc))
    for number, seed in enumerate(used):
        h = K.mix(masked(tok.hash, seed) + np.uint64(number + 1))
        at = np.flatnonzero(row[: len(h)] == row[seed[-1] :]) if len(h) else np.zeros(0, np.int64)
        at = at[allowed(number, h[at], row[at])]
        for i in range(0, len(at), _WINDOWS):
            yield h[at[i : i + _WINDOWS]], at[i : i + _WINDOWS]


def _joined(documents: DataFrame, items: DataFrame, config: LeakConfig) -> DataFrame:
    """t1, t2 (digests of a text), item_id, agreeing, compared: the leaks of all texts by a shuffled hash join."""
    reach = config.window - 1
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(K.tokenize(batch.column(0)).doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(size[size > 0], config.window)), pa.int64())], ["width"])

    found = sorted(r.width for r in map_batches(items.select("text"), widths, "width long").distinct().collect())
    used = sorted({seed for width in found for seed in config.seeds(width)})
    by_width = np.zeros((len(used), config.window + 1), dtype=bool)
    for width in found:
        by_width[[used.index(seed) for seed in config.seeds(width)], width] = True

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok = K.tokenize(batch.column(1))
            width = np.minimum(np.diff(tok.doc), config.window)
            for h, at in _hits(tok, used, lambda number, h, row: by_width[number, width[row]]):
                row = np.searchsorted(tok.doc, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(width[row], pa.int32()), _binary(_around(tok, at, reach, 1))],
                    ["h", "item", "width", "want"],
                )

    keys = cut(map_batches(items.select("item", "text"), index, "h long, item long, width int, want binary"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 AS int))")
    words = keys.groupBy(F.shiftrightunsigned("h", 46).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
    sieve = np.zeros(1 << (_SIEVE - 6), dtype=np.int64)
    for r in words:
        sieve[r.at] = r.bits
    sent = documents.sparkSession.sparkContext.broadcast(np.unpackbits(sieve.view(np.uint8), bitorder="little"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = sent.value.astype(bool)
        for batch in batches:
            for a, b in K.slices(batch.column(2)):
                tok = K.tokenize(batch.column(2).slice(a, b - a))
                for h, at in _hits(tok, used, lambda number, h, row: passed[h >> np.uint64(64 - _SIEVE)]):
                    row = pa.array(np.searchsorted(tok.doc, at, side="right") - 1 + a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), _binary(_around(tok, at, reach, 0))], ["h", "t1", "t2", "have"]
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = np.array([config.need(w) for w in range(config.window + 1)])
        for batch in batches:
            want, have = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, 2 * reach + 1) for c in (4, 5))
            width = batch.column(3).to_numpy()
            best = np.zeros(len(width), np.int64)
            total = lambda x: np.concatenate((np.zeros((len(x), 1), np.int64), np.cumsum(x, axis=1)), axis=1)
            same, own = total(want == have), total(want != 1)
            for w in np.unique(width):
                of = np.flatnonzero(width == w)
                whole = own[of, w:] - own[of, :-w] == w
                best[of] = np.where(whole, same[of, w:] - same[of, :-w], 0).max(axis=1)
            good = pa.array(best >= need[width])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best, pa.int32()), batch.column(3)], ["t1", "t2", "item", "agreeing", "compared"]).filter(good)

    texts = map_batches(_digested(documents.select("text")).select("t1", "t2", "text"), windows, "h long, t1 long, t2 long, have binary")
    pairs = map_batches(texts.join(keys, "h").select("t1", "t2", "item", "width", "want", "have"), verify, "t1 long, t2 long, item long, agreeing int, compared int")
    best = pairs.groupBy("t1", "t2", "item", "compared").agg(F.max("agreeing").alias("agreeing"))
    return best.join(items.select("item", "item_id"), "item").select("t1", "t2", "item_id", "agreeing", "compared")


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def _digested(documents: DataFrame, *names: str) -> DataFrame:
    first, second = names or ("t1", "t2")
    return documents.withColumns({first: fingerprint("text"), second: fingerprint(F.lit(1), "text")})


def leaks(documents: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """doc_id, item_id, agreeing, compared: every document row with every item that it leaks."""
    rows, items = documents.select("doc_id", "text"), _items(benchmark)
    index = _index(items, config)
    if index is None:
        found = _digested(rows).join(_joined(rows, items, config), ["t1", "t2"])
        return found.select("doc_id", "item_id", "agreeing", "compared")
    kinds = {"doc_id": documents.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    schema = StructType([*(StructField(name, kind) for name, kind in kinds.items()), StructField("agreeing", IntegerType()), StructField("compared", IntegerType())])
    kind = to_arrow_type(kinds["item_id"])
    sent = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(1)):
                row, item, same, of = sent.value.find(K.tokenize(batch.column(1).slice(a, b - a)))
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row + a)), pa.array([sent.value.ids[i] for i in item], kind), pa.array(same, pa.int32()), pa.array(of, pa.int32())],
                        schema.names,
                    )

    return map_batches(rows, run, schema)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """The documents that leak no benchmark item, with the columns they came with; no shuffle of them while the leaks are few."""
    items = _items(benchmark)
    index = _index(items, config)
    if index is None:
        names = spare(documents, "t1"), spare(documents, "t2")
        gone = cut(_joined(documents, items, config).select(F.col("t1").alias(names[0]), F.col("t2").alias(names[1])).distinct())
        few = gone.count() <= config.broadcast_leaks
        return _digested(documents, *names).join(F.broadcast(gone) if few else gone, list(names), "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
    at = documents.columns.index("text")
    sent = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for a, b in K.slices(batch.column(at)):
                clean[a + sent.value.find(K.tokenize(batch.column(at).slice(a, b - a)))[0]] = False
            yield batch.filter(pa.array(clean))

    return map_batches(documents, run, documents.schema)
