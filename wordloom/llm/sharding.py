"""Sharding by extendible hashing.

A document's hash is 60 bits of md5 over its id and text.  The directory starts
as one bucket; a bucket above ``limit`` bytes is split on the next bit of the
hash prefix, and only it, until every bucket fits.  A shard is named by its
prefix bits; ``depth`` is their number.

The directory is a table of its leaves (:func:`directory`), found bottom-up:
documents are summed into cells of a fixed prefix length that follows the total
size, and sibling buckets are merged as long as their parent fits.  Merging goes
up in tiers of ``tier_bits``: a task merges all cells below its prefixes of the
next tier at once, so nothing larger than a tier's cells meets in one place.
Cells that are too large themselves are taken up again, alone, with
``more_bits`` more bits.  Rows find their leaf by their cell.

:func:`assign` shuffles no text; :func:`shard_documents` carries the rows
themselves to their shards.

Defined results: a document above the limit is a shard by itself.  Rows whose
60 bits are all equal (repeated rows) and that exceed the limit together are
paged: ``page`` counts shards of the same prefix, each within the limit; such
rows are counted by task, and no task sees all of them.  Null or empty texts
have 0 bytes; null ids hash as the empty string.  Every row is assigned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import map_batches
from .tables import cut, spare

BITS = 60
CELLS = "prefix long, depth int, size long, n long"


@dataclass(frozen=True)
class ShardConfig:
    """``broadcast_cells``: so many cells of a round are broadcast at most; more of them are joined by shuffle."""

    limit: int = 16 << 20
    more_bits: int = 8
    tier_bits: int = 10
    broadcast_cells: int = 1 << 20


def _hashed(size_name: str, hash_name: str) -> list[Column]:
    """Columns for the bytes and the hash of a document."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return [size.alias(size_name), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias(hash_name)]


def _merge(prefix: np.ndarray, high: int, size: np.ndarray, n: np.ndarray, low: int, limit: int) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(prefixes, depth, sizes, counts): the leaves deeper than ``low`` bits, and last all buckets of ``low`` bits, of some cells."""
    out, fits = [], (size <= limit) | (n == 1)
    for level in range(high, low, -1):
        by = np.argsort(prefix, kind="stable")
        prefix, size, n, fits = prefix[by], size[by], n[by], fits[by]
        parent = prefix >> 1
        first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        total, count = np.add.reduceat(size, first), np.add.reduceat(n, first)
        above = (total <= limit) | (count == 1)
        final = fits & ~np.repeat(above, np.diff(np.append(first, len(parent))))
        out.append((prefix[final], level, size[final], n[final]))
        prefix, size, n, fits = parent[first], total, count, above
    return [*out, (prefix, low, size, n)]


def _tier(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Leaves deeper than ``low``, and all buckets of ``low`` bits, of cells of ``high`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            t = pa.Table.from_batches(found)
            for p, depth, s, n in _merge(t["prefix"].to_numpy(), high, t["size"].to_numpy(), t["n"].to_numpy(), low, limit):
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(np.full(len(p), depth), pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64())], ["prefix", "depth", "size", "n"])

    return cut(map_batches(cells.repartition(F.shiftright("prefix", high - low)), run, CELLS))


def _leaves(cells: DataFrame, low: int, high: int, config: ShardConfig) -> DataFrame:
    """The buckets of low to high bits that fit while their parents don't; buckets of low bits have no parent."""
    out = cells.limit(0)
    while high > low:
        base = max(low, high - config.tier_bits)
        cells = _tier(cells, base, high, config.limit)
        out = out.unionByName(cells.where(F.col("depth") > base))
        cells, high = cells.where(F.col("depth") == base), base
    return out.unionByName(cells.where((F.col("size") <= config.limit) | (F.col("n") == 1)))


@dataclass
class _Round:
    """Leaves merged from cells of ``bits`` bits, and the cells that exceed the limit by themselves."""

    bits: int
    leaves: DataFrame
    over: DataFrame


def _rounds(rows: DataFrame, config: ShardConfig) -> list[_Round]:
    """The directory for rows (n_bytes, h)."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(4, math.ceil(math.log2(max(1.0, total / config.limit))) + 3))
    found = []
    while True:
        cells = rows.groupBy(F.shiftright("h", BITS - high).alias("prefix")).agg(F.sum("n_bytes").alias("size"), F.count("*").alias("n"))
        cells = cut(cells.select("prefix", F.lit(high).alias("depth"), "size", "n"))
        over = cells.where((F.col("size") > config.limit) & (F.col("n") > 1))
        found.append(_Round(high, _leaves(cells, low, high, config), over))
        if high == BITS or over.isEmpty():
            return found
        rows = rows.join(_small(over.select("prefix"), config), F.shiftright("h", BITS - high) == F.col("prefix"), "left_semi")
        low, high = high + 1, min(BITS, high + config.more_bits)


def _small(cells: DataFrame, config: ShardConfig) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= config.broadcast_cells else cells


def _name(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def directory(documents: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """shard, depth, n_bytes, n_docs: every shard; the pages of one hash together."""
    rounds = _rounds(cut(documents.select(*_hashed("n_bytes", "h"))), config)
    leaves = rounds[-1].over
    for part in rounds:
        leaves = leaves.unionByName(part.leaves)
    return leaves.select(_name(F.col("prefix"), F.col("depth")).alias("shard"), F.col("depth").cast("long").alias("depth"), F.col("size").alias("n_bytes"), F.col("n").alias("n_docs"))


def _placed(rows: DataFrame, hashes: DataFrame, names: tuple[str, ...], config: ShardConfig) -> DataFrame:
    """``rows`` with their shard, depth and page; ``hashes`` (n_bytes, h) stands for the same rows; ``names`` has those of all five."""
    size, h, shard, depth, page = names
    rounds, done, cell = _rounds(hashes, config), None, spare(rows, "cell")
    for number, part in enumerate(rounds):
        span = F.expr(f"shiftleft(1L, {part.bits} - depth)")
        cells = F.explode(F.sequence(F.col("prefix") * span, (F.col("prefix") + 1) * span - 1))
        places = cut(part.leaves.select(F.col("depth").alias(depth), cells.alias(cell)))
        own = F.shiftright(h, BITS - part.bits)
        found = rows.join(_small(places, config), own == F.col(cell)).drop(cell).withColumn(page, F.lit(0))
        done = found if done is None else done.unionByName(found)
        if number + 1 < len(rounds) or part.bits == BITS:
            rows = rows.join(_small(part.over.select(F.col("prefix").alias(cell)), config), own == F.col(cell), "left_semi")
    if rounds[-1].bits == BITS:
        done = done.unionByName(_paged(rows, size, h, depth, page, config.limit).select(done.columns))
    name = _name(F.expr(f"shiftright(`{h}`, {BITS} - `{depth}`)"), F.col(depth))
    return done.withColumn(shard, name).withColumns({depth: F.col(depth).cast("long"), page: F.col(page).cast("long")})


def _paged(rows: DataFrame, size: str, h: str, depth: str, page: str, limit: int) -> DataFrame:
    """Rows with all bits equal: as many to a page as fit.  They are numbered task by task, from where earlier tasks end."""
    part, at, begin = (spare(rows, x) for x in ("part", "at", "begin"))
    rows = cut(rows.withColumn(part, F.spark_partition_id()))
    sizes = rows.groupBy(h, part).agg(F.count("*").alias(at))
    earlier = Window.partitionBy(h).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn(begin, F.coalesce(F.sum(at).over(earlier), F.lit(0))).drop(at)
    local = Window.partitionBy(h, part).orderBy(size)
    numbered = rows.withColumn(at, F.row_number().over(local) - 1).join(begins, [h, part])
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(size)))
    return numbered.withColumn(page, F.floor((F.col(begin) + F.col(at)) / each).cast("int")).withColumn(depth, F.lit(BITS))


def assign(documents: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """doc_id, n_bytes, shard, depth, page: one row for every document row; no other column than doc_id and text is read."""
    rows = cut(documents.select("doc_id", *_hashed("n_bytes", "h")))
    return _placed(rows, rows.select("n_bytes", "h"), ("n_bytes", "h", "shard", "depth", "page"), config).select("doc_id", "n_bytes", "shard", "depth", "page")


def shard_documents(documents: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """The rows with all their columns, and shard, depth, page (with underscores before names that are taken)."""
    names = tuple(spare(documents, x) for x in ("n_bytes", "h", "shard", "depth", "page"))
    hashes = cut(documents.select(*_hashed("n_bytes", "h")))
    rows = documents.select("*", *_hashed(*names[:2]))
    return _placed(rows, hashes, names, config).select(*(F.col(f"`{c}`") for c in documents.columns), *names[2:])


def _placed_sql(documents: str, config: ShardConfig) -> str:
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM {documents}),
levels AS (SELECT *, unnest(generate_series(0, {BITS})) AS level FROM rows),
prefixes AS (SELECT *, h >> ({BITS} - level)::INTEGER AS prefix FROM levels),
fits AS (SELECT level, prefix FROM prefixes GROUP BY level, prefix HAVING sum(n_bytes) <= {config.limit} OR count(*) = 1),
leaf AS (SELECT h, min(level) AS depth FROM (SELECT DISTINCT h, level, prefix FROM prefixes) JOIN fits USING (level, prefix) GROUP BY h),
placed AS (
  SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - d)::INTEGER), d::INTEGER, '0') END AS shard, d::BIGINT AS depth,
    CASE WHEN depth IS NULL THEN (row_number() OVER (PARTITION BY h) - 1) // greatest(1, {config.limit} // greatest(1, n_bytes)) ELSE 0 END::BIGINT AS page
  FROM (SELECT *, coalesce(depth, {BITS}) AS d FROM rows LEFT JOIN leaf USING (h)))"""


def shard_sql(documents: str = "documents", config: ShardConfig = ShardConfig()) -> str:
    """DuckDB SQL of :func:`assign`."""
    return f"{_placed_sql(documents, config)} SELECT doc_id, n_bytes, shard, depth, page FROM placed"


def directory_sql(documents: str = "documents", config: ShardConfig = ShardConfig()) -> str:
    """DuckDB SQL of :func:`directory`."""
    return f"{_placed_sql(documents, config)} SELECT shard, depth, sum(n_bytes)::BIGINT AS n_bytes, count(*) AS n_docs FROM placed GROUP BY shard, depth"
