"""Near-duplicate grouping: 256-bit SimHash and random bit sampling.

A document's signature is the SimHash of its different word bigrams (unigram for
a single word).  Equal signatures are one node.  ``tables(n)`` hash tables each group the
nodes by sampled signature bits; a bucket above ``bucket_cap`` is split on
further sampled bits of its table, again and again, until every part fits.  All
pairs of a part are then verified by their Hamming distance, and verified pairs
are joined into groups by connected components over node numbers.

No task gathers a bucket of any size: a bounded sample of the nodes
(``sample_nodes``) tells which buckets hold more than ``hot_caps`` caps, and
their nodes get so many more key bits before they are shuffled that the parts
come down to that; the rest of the splitting is done where a part arrives.  The
sample decides only where a bucket is split, not what is compared after it.

The number of sampled bits follows the number of nodes (about ``strangers`` of
them share a bucket at any size, as comparing is cheaper than shuffling more
tables), and the number of tables follows from it, so that a pair at
``design_distance`` is found with probability ``design_recall`` at any size.
Nodes of a split bucket share more bits and meet in fewer tables.

Radius: unrelated texts of one language differ in 90 of 256 bits or more, and
the chance to come within 56 falls by about half with every two bits, which is
why the signature has 256 bits; edited copies that keep 60 % of their word
3-grams lie within 56.

Defined results: texts without a word (null, empty, punctuation) have no
signature and are groups of their own.  A group is named by its smallest doc_id
(null last); one row of each group is kept, the first by (doc_id, content hash).
Rows equal in every column are one document and listed once, with their number
in ``n_rows``.  A null doc_id is carried as null; doc_id may have any type with
an order, and other columns any type at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_batches
from . import kernels as K
from .components import components
from .tables import cut, kind, row_key, spare

BITS = 256
_WIDTH = BITS // 8
#: The columns of a signature, 64 bits each.
SIGNATURE = [f"s{k}" for k in range(BITS // 64)]
_WORDS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass(frozen=True)
class SimHashConfig:
    radius: int = 56
    design_distance: int = 50
    design_recall: float = 0.95
    strangers: int = 512
    bucket_cap: int = 2048
    hot_caps: int = 16
    sample_nodes: int = 1 << 16
    seed: int = 5

    def sampled_bits(self, nodes: int) -> int:
        return min(40, max(4, math.ceil(math.log2(max(2, nodes / self.strangers)))))

    def tables(self, nodes: int) -> int:
        agree = (1 - self.design_distance / BITS) ** self.sampled_bits(nodes)
        return math.ceil(math.log(1 - self.design_recall) / math.log(1 - agree))

    def coordinates(self, nodes: int) -> np.ndarray:
        """For each table a permutation of the bits: the first are its key, the others split its large buckets."""
        rng = np.random.default_rng(self.seed)
        return np.stack([rng.permutation(BITS) for _ in range(self.tables(nodes))])


def distinct(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of each row, so that a repeated phrase weighs no more than another."""
    n, bits = len(offsets) - 1, np.uint64(K.SLICE_ROWS.bit_length())
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    key = np.unique(row << (np.uint64(64) - bits) | grams >> bits)
    ends = np.searchsorted(key >> (np.uint64(64) - bits), np.arange(n + 1, dtype=np.uint64), side="left")
    return K.mix(key << bits), ends


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each text in bytes, and which texts have none for lack of a word."""
    out = np.zeros((len(column), _WIDTH), dtype=np.uint8)
    empty = np.zeros(len(column), dtype=bool)
    for a, b in K.slices(column):
        tok = K.tokenize(column.slice(a, b - a))
        grams, offsets = K.ngrams(tok, 2)
        words = np.diff(tok.doc)
        single = np.flatnonzero(words == 1)
        if len(single):
            grams = np.insert(grams, offsets[single], tok.hash[tok.doc[single]])
            offsets = offsets + np.concatenate(([0], np.cumsum(words == 1)))
        empty[a:b] = words == 0
        grams, offsets = distinct(grams, offsets)
        count = np.diff(offsets)
        parts = np.maximum((count + 254) // 255, 1)
        first = np.concatenate(([0], np.cumsum(parts)))
        start = np.repeat(offsets[:-1], parts) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], parts))
        some = np.flatnonzero(start < np.repeat(offsets[1:], parts))
        bits = np.zeros((b - a, BITS), dtype=bool)
        for word, seed in enumerate(_WORDS):
            h = K.mix(grams ^ np.uint64(seed)) if seed else grams
            lanes = h.view(np.uint8).reshape(-1, 8)
            for j in range(8):
                partial = np.zeros(first[-1], dtype=np.uint64)
                if len(some):
                    partial[some] = np.add.reduceat(_LANES[lanes[:, j]], start[some])
                ones = np.add.reduceat(partial.view(np.uint8).reshape(-1, 8).astype(np.int64), first[:-1], axis=0)
                bits[:, word * 64 + j * 8 : word * 64 + j * 8 + 8] = ones * 2 > count[:, None]
        out[a:b] = np.packbits(bits, axis=1)
    return out, empty


def packed(values: np.ndarray, empty: np.ndarray | None = None) -> list[pa.Array]:
    """Signatures in bytes as the columns of :data:`SIGNATURE`."""
    words = np.ascontiguousarray(values).view(np.int64)
    return [pa.array(np.ascontiguousarray(words[:, k]), pa.int64(), mask=empty) for k in range(words.shape[1])]


def unpacked(columns: list[pa.Array]) -> np.ndarray:
    """The reverse of :func:`packed` for signatures without nulls."""
    return np.stack([np.asarray(c) for c in columns], axis=1).view(np.uint8) if len(columns[0]) else np.zeros((0, _WIDTH), np.uint8)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least label of each of n nodes under the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def close_pairs(sig: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions in the same run (sorted ids) whose signatures differ in at most ``radius`` bits."""
    words = np.ascontiguousarray(sig).view(np.uint64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    last = np.searchsorted(run, run, side="right")
    live = np.flatnonzero(np.arange(len(run)) + 1 < last)
    step = 1
    while len(live):
        other = live + step
        far = np.bitwise_count(words[live] ^ words[other]).sum(axis=1, dtype=np.int64)
        hit = far <= radius
        left.append(live[hit])
        right.append(other[hit])
        step += 1
        live = live[live + step < last[live]]
    return np.concatenate(left), np.concatenate(right)


def _split(bits: np.ndarray, run: np.ndarray, order: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Split runs above the cap on one more coordinate at a time; returns a permutation and the new run ids."""
    perm = np.arange(len(run))
    for place in range(order.shape[1]):
        edge = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        size = np.diff(np.append(edge, len(run)))
        large = np.repeat(size > cap, size)
        if not large.any():
            break
        more = np.zeros(len(run), dtype=np.int64)
        rows = perm[large]
        more[large] = bits[rows, order[rows, place]]
        key = np.repeat(np.arange(len(edge)), size) * 2 + more
        by = np.argsort(key, kind="stable")
        perm, run = perm[by], key[by]
    return perm, run


def edges_of(keys: np.ndarray, sig: np.ndarray, coordinates: np.ndarray, k: int, config: SimHashConfig) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (member, least member) among rows sorted by bucket key, as places in them."""
    run = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
    size = np.bincount(run)
    many = np.repeat(size > 1, size)
    place = np.flatnonzero(many)
    keys, sig, run = keys[many], sig[many], run[many]
    if len(run) == 0:
        return place, place
    if size.max() > config.bucket_cap:
        large = np.flatnonzero(np.repeat(size[size > 1] > config.bucket_cap, size[size > 1]))
        bits = np.unpackbits(sig[large], axis=1)
        perm, parts = _split(bits, run[large], coordinates[(keys[large] >> k).astype(np.int64)][:, k:], config.bucket_cap)
        sig, place, run = sig.copy(), place.copy(), run * 2 + 1
        sig[large], place[large] = sig[large][perm], place[large][perm]
        # parts of one bucket stay apart from each other and from all other buckets
        new = np.zeros(len(run), dtype=bool)
        new[0] = True
        new[1:] = run[1:] != run[:-1]
        new[large[1:][parts[1:] != parts[:-1]]] = True
        run = np.cumsum(new)
    a, b = close_pairs(sig, run, config.radius)
    root = _forest(a, b, len(run))
    member = np.flatnonzero(root != np.arange(len(run)))
    return place[member], place[root[member]]


def hot_buckets(sample: np.ndarray, total: int, coordinates: np.ndarray, k: int, config: SimHashConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table the sorted keys of buckets that a sample of ``total`` nodes shows to be far above the cap, and the bits they need more."""
    weight, bits = np.left_shift(np.int64(1), np.arange(k, dtype=np.int64)), np.unpackbits(sample, axis=1)
    scale, found = total / max(1, len(sample)), []
    for order in coordinates:
        key, count = np.unique(bits[:, order[:k]].astype(np.int64) @ weight, return_counts=True)
        parts = count * scale / (config.hot_caps * config.bucket_cap)
        hot = (parts > 1) & (count >= 8)
        found.append((key[hot], np.minimum(np.ceil(np.log2(parts[hot])), 20).astype(np.int64)))
    return found


def _signed(documents: DataFrame) -> DataFrame:
    """doc_id, content, content2 (hashes of the row), and the signature."""
    names = spare(documents, "content"), spare(documents, "content2")
    rows = documents.withColumns({names[0]: row_key(documents), names[1]: row_key(documents, 1)}).select("doc_id", *names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed(*signatures(batch.column(3)))], ["doc_id", "content", "content2", *SIGNATURE])

    return map_batches(rows, run, f"doc_id {kind(documents, 'doc_id')}, content long, content2 long, {', '.join(f'{c} long' for c in SIGNATURE)}")


def near_edges(nodes: DataFrame, total: int, config: SimHashConfig) -> DataFrame:
    """Verified edges (a, b) among nodes (node, signature)."""
    k, coordinates = config.sampled_bits(total), config.coordinates(total)
    every = max(1, total // config.sample_nodes)
    sample = nodes.where(F.pmod(F.xxhash64(*SIGNATURE), F.lit(every)) == 0).select(*SIGNATURE) if every > 1 else nodes.select(*SIGNATURE)
    t = sample.limit(2 * config.sample_nodes).toArrow()
    hot = hot_buckets(unpacked([t[c].combine_chunks() for c in SIGNATURE]), total, coordinates, k, config)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.left_shift(np.int64(1), np.arange(k, dtype=np.int64))
        for batch in batches:
            bits = np.unpackbits(unpacked(batch.columns[1:]), axis=1)
            for t, order in enumerate(coordinates):
                key = bits[:, order[:k]].astype(np.int64) @ weight
                part = np.zeros(len(key), np.int64)
                keys, more = hot[t]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    within = np.flatnonzero(keys[at] == key)
                    for extra in np.unique(more[at[within]]).tolist():
                        rows = within[more[at[within]] == extra]
                        part[rows] = bits[np.ix_(rows, order[k : k + extra])].astype(np.int64) @ np.left_shift(np.int64(1), np.arange(extra, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key | np.int64(t << k)), pa.array(part, pa.int32()), *batch.columns], ["key", "part", "node", *SIGNATURE])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            keys, part = np.asarray(held.column(0)), np.asarray(held.column(1))
            other = np.flatnonzero((keys != keys[-1]) | (part != part[-1]))
            done = int(other[-1]) + 1 if len(other) else 0
            if done:
                yield edges(held.slice(0, done))
                held = held.slice(done)
        if held is not None:
            yield edges(held)

    def edges(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys, part, node = (np.asarray(rows.column(c)) for c in range(3))
        sig = unpacked(rows.columns[3:])
        found = [np.zeros((2, 0), np.int64)]
        # parts of one key are buckets of their own
        for p in np.unique(part).tolist():
            of = np.flatnonzero(part == p)
            found.append(node[of[np.stack(edges_of(keys[of], sig[of], coordinates, k, config))]])
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    probes = map_batches(nodes.select("node", *SIGNATURE), probe, f"key long, part int, node long, {', '.join(f'{c} long' for c in SIGNATURE)}")
    return map_batches(probes.repartition("key", "part").sortWithinPartitions("key", "part"), verify, "a long, b long").distinct()


def near_groups(documents: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """doc_id, group_id, keep, n_rows and the row's content hashes, one row for each distinct document row."""
    rows = cut(_signed(documents).groupBy("doc_id", "content", "content2", *SIGNATURE).agg(F.count("*").alias("n_rows")))
    nodes = rows.where("s0 IS NOT NULL").select(*SIGNATURE).distinct()
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), *SIGNATURE))
    roots = components(near_edges(nodes, nodes.count(), config)).withColumnRenamed("node", "_node")
    named = nodes.join(roots, F.col("node") == F.col("_node"), "left").select(*SIGNATURE, F.coalesce("root", "node").alias("root"))
    signed = rows.where("s0 IS NOT NULL").join(named, SIGNATURE).select("doc_id", "content", "content2", "n_rows", "root")
    first = signed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "content2")).alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in ("doc_id", "content", "content2")]
    found = signed.join(first, "root").select("doc_id", F.col("first.doc_id").alias("group_id"), (same[0] & same[1] & same[2]).alias("keep"), "n_rows", "content", "content2")
    alone = rows.where("s0 IS NULL").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(True).alias("keep"), "n_rows", "content", "content2")
    return found.unionByName(alone)


def drop_near_copies(documents: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """The documents without all but one of each near-duplicate group; other columns unchanged."""
    own, kept = ([spare(documents, f"{x}{k}") for k in range(2)] for x in ("own", "kept"))
    keep = near_groups(documents, config).where("keep").select(F.col("content").alias(kept[0]), F.col("content2").alias(kept[1]))
    rows = documents.withColumns({own[0]: row_key(documents), own[1]: row_key(documents, 1)})
    joined = rows.join(keep, (F.col(kept[0]) == F.col(own[0])) & (F.col(kept[1]) == F.col(own[1])))
    return joined.dropDuplicates(own).drop(*own, *kept)
