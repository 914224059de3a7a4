"""Incremental, reversible line deduplication.

The state below a folder only ever grows by new files, and a change counts once
its entry is in the log, so a failed change leaves the index as it was:

* ``refs/<run>`` — the exact reference table of one inserted batch: every
  occurrence of a line (128-bit digest) in a document, sorted by digest.  Each
  document also refers to itself, at place -1.  The number of a line's rows is
  its reference count; the first of them by (batch, doc_id, content, place) owns
  the line: that occurrence is kept and all others are dropped.
* ``filters/<version>`` — a cuckoo filter for each hash shard of a run's
  different lines; newer versions replace those of the same run and shard.
* ``gone/<version>`` — the documents that a deletion took out; they hide the
  references of the runs it touched.
* ``log/<version>`` — what each version did: into how many shards a run is
  divided (the number follows the run's lines, so a shard stays small), and
  which runs a deletion touched or emptied.

Inserting a batch probes the filters of earlier runs with its documents, and its
texts (:meth:`LineIndex.texts`) are found by probing them with its lines: what a
filter surely lacks is new and is never looked up; only possible hits are joined
with earlier references, of which only the row groups of the hit shards are read
while these are few.  Deleting documents hides their references, takes lines
that no document of a run refers to any more out of its filter, and passes
others on to their next reference, so the result is as if the deleted documents
had never been inserted.  :meth:`LineIndex.compact` merges all runs into one.

Defined results: a line is what stands between line feeds, compared by its
128-bit digest; blank lines are always kept and not counted.  A null text has no
lines and stays null.  Rows equal in doc_id and text are one document, listed
once, and so is a document that is inserted again.  Null ids come last in the
order.  doc_id may have any type with an order.  Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .cuckoo import CuckooFilter
from .tables import cut, fingerprint

FILTERS = "run int, shard int, filter binary, full boolean"
LOG = "version int, kind string, shards int, touched array<int>, emptied array<int>"
KEYS = ["k1", "k2"]
LINE = ["d1", "d2"]


@dataclass(frozen=True)
class LineConfig:
    """``shard_lines``: lines of a filter shard; ``few_shards``: up to so many hit shards are looked up by their ranges."""

    shard_lines: int = 200_000
    few_shards: int = 256


@dataclass(frozen=True)
class Run:
    """References below ``refs/<version>``, with filters in ``shards`` shards."""

    version: int
    shards: int


def _documents(documents: DataFrame) -> DataFrame:
    keys = [fingerprint("doc_id", "text").alias("k1"), fingerprint(F.lit(1), "doc_id", "text").alias("k2")]
    return documents.select("doc_id", "text", *keys)


def _shard(shards: int) -> Column:
    """Shard of a line: the range of d2 it lies in."""
    return F.shiftright((F.shiftright("d2", 40) + F.lit(1 << 23)) * F.lit(shards), 24).cast("int")


def _range(shard: int, shards: int) -> Column:
    """A condition on d2 that all lines of a shard meet."""
    low, high = -(-(shard << 24) // shards), -(-((shard + 1) << 24) // shards)
    return F.col("d2").between((low - (1 << 23)) << 40, min(((high - (1 << 23)) << 40) - 1, (1 << 63) - 1))


def _owner() -> Column:
    return F.struct("batch", F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "place")


def _keys(lines: pa.Table) -> np.ndarray:
    return np.asarray(lines["d1"].combine_chunks()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(lines["d2"].combine_chunks()).astype(np.uint64)


def _row(of: pa.Table, held: CuckooFilter) -> pa.Table:
    return pa.table({"run": of["run"].slice(0, 1), "shard": of["shard"].slice(0, 1), "filter": pa.array([held.dump()], pa.binary()), "full": pa.array([False])})


def _build(lines: pa.Table) -> pa.Table:
    return _row(lines, CuckooFilter.build(_keys(lines)))


def _drop(lines: pa.Table, filters: pa.Table) -> pa.Table:
    if not lines.num_rows or not filters.num_rows:
        return _EMPTY
    held = CuckooFilter.load(filters["filter"][0].as_py())
    held.drop(_keys(lines))
    return _row(filters, held)


def _possible(lines: pa.Table, filters: pa.Table) -> pa.Table:
    lines = lines.select(["shard", "d1", "d2"])
    if not filters.num_rows or not lines.num_rows:
        return lines.slice(0, 0)
    return lines.filter(pa.array(CuckooFilter.load(filters["filter"][0].as_py()).has(_keys(lines))))


_EMPTY = pa.table({"run": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary()), "full": pa.array([], pa.bool_())})


class LineIndex:
    """The line index below ``path``; :meth:`open` finds what an earlier session wrote there."""

    def __init__(self, spark: SparkSession, path: str, config: LineConfig = LineConfig()):
        ship(spark)
        self.spark, self.path, self.config = spark, path, config
        self.version, self.runs, self.changed = 0, [], {}

    @staticmethod
    def open(spark: SparkSession, path: str, config: LineConfig = LineConfig()) -> LineIndex:
        """The index as its log tells; an empty one where there is none."""
        index = LineIndex(spark, path, config)
        try:
            entries = spark.read.schema(LOG).json(os.path.join(path, "log", "*")).collect()
        except AnalysisException:
            return index
        for entry in sorted(entries, key=lambda e: e.version):
            index._apply(*entry)
        return index

    def _apply(self, version: int, kind: str, shards: int, touched: list[int], emptied: list[int]) -> None:
        self.version = version
        if kind == "delete":
            self.runs = [run for run in self.runs if run.version not in emptied]
            for run in touched:
                self.changed.setdefault(run, []).append(version)
        else:
            self.runs = [*([] if kind == "compact" else self.runs), Run(version, shards)]

    def _at(self, *names) -> str:
        return os.path.join(self.path, *map(str, names))

    def _commit(self, kind: str, shards: int = 0, touched: Iterable[int] = (), emptied: Iterable[int] = ()) -> None:
        """The entry of the version whose files are all written; it is what makes it count."""
        entry = (self.version + 1, kind, shards, list(touched), list(emptied))
        self.spark.createDataFrame([entry], LOG).coalesce(1).write.mode("overwrite").json(self._at("log", entry[0]))
        self._apply(*entry)

    def run(self, run: Run) -> DataFrame:
        """d1, d2, doc_id, k1, k2, place, batch: the references of a run, without those of deleted documents."""
        refs = self.spark.read.parquet(self._at("refs", run.version))
        for version in self.changed.get(run.version, ()):
            refs = refs.join(self.spark.read.parquet(self._at("gone", version)), KEYS, "left_anti")
        return refs

    @property
    def refs(self) -> DataFrame | None:
        """All references, or None in an empty index."""
        return reduce(DataFrame.unionByName, map(self.run, self.runs)) if self.runs else None

    def filters(self, run: Run) -> DataFrame:
        """run, shard, filter: the newest filters of a run."""
        read = lambda v: self.spark.read.schema(FILTERS).parquet(self._at("filters", v)).where(F.col("run") == run.version).drop("full")
        found = read(run.version)
        for version in self.changed.get(run.version, ()):
            newer = read(version)
            found = found.join(newer.select("shard"), "shard", "left_anti").unionByName(newer)
        return found

    def _lines(self, documents: DataFrame) -> DataFrame:
        """d1, d2, doc_id, k1, k2, place: all occurrences of lines that aren't blank, and each document itself."""
        rows = _documents(documents)
        lines = rows.select("doc_id", *KEYS, F.posexplode(F.split("text", "\n")).alias("place", "line")).where("line RLIKE '[^ \\t\\r]'")
        lines = lines.select(F.xxhash64("line").alias("d1"), F.xxhash64(F.lit(1), "line").alias("d2"), "doc_id", *KEYS, "place")
        return lines.unionByName(rows.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), "doc_id", *KEYS, F.lit(-1).alias("place")))

    def _hits(self, lines: DataFrame, run: Run) -> DataFrame | None:
        """References of ``run`` to some different lines (d1, d2): the filters are asked first, and only possible hits are looked up.

        None where the filters lack all of them.
        """
        asked = lines.withColumn("shard", _shard(run.shards))
        possible = cut(asked.groupBy("shard").cogroup(self.filters(run).groupBy("shard")).applyInArrow(_possible, "shard int, d1 long, d2 long"))
        refs, few = self.run(run), self.config.few_shards
        shards = [r.shard for r in possible.select("shard").distinct().limit(few + 1).collect()]
        if not shards:
            return None
        if len(shards) <= few:
            refs = refs.where(reduce(Column.__or__, (_range(s, run.shards) for s in shards), F.lit(False)))
        return refs.join(possible.select(*LINE), LINE, "left_semi")

    def _write(self, refs: DataFrame, kind: str) -> None:
        """A new run from references: sorted by line, hot lines apart, then its filters."""
        version = self.version + 1
        placed = refs.repartitionByRange("d2", "k1", "place").dropDuplicates(["d1", "d2", "k1", "k2", "place"])
        placed.sortWithinPartitions("d2").write.mode("overwrite").parquet(self._at("refs", version))
        lines = self.spark.read.parquet(self._at("refs", version)).select(*LINE).distinct()
        lines = cut(lines)
        shards = max(1, min(1 << 23, -(-lines.count() // self.config.shard_lines)))
        rows = lines.withColumn("shard", _shard(shards)).withColumn("run", F.lit(version))
        rows.groupBy("shard").applyInArrow(_build, FILTERS).write.mode("overwrite").parquet(self._at("filters", version))
        self._commit(kind, shards)

    def insert(self, documents: DataFrame) -> int:
        """Insert the documents that the index doesn't hold yet; returns the number of their batch."""
        lines = self._lines(documents)
        if self.runs:
            keys = _documents(documents).select(F.col("k1").alias("d1"), F.col("k2").alias("d2")).distinct()
            known = [hits.where("place = -1").select(*KEYS) for hits in (self._hits(keys, run) for run in self.runs) if hits is not None]
            if known:
                known = cut(reduce(DataFrame.unionByName, known))
                lines = lines if known.isEmpty() else lines.join(known, KEYS, "left_anti")
        self._write(lines.withColumn("batch", F.lit(self.version + 1)), "insert")
        return self.version

    def delete(self, documents: DataFrame) -> None:
        """Take documents (doc_id, text) out again; those the index doesn't hold are ignored."""
        version = self.version + 1
        keys = cut(_documents(documents).select(*KEYS).distinct())
        asked = keys.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"))
        changed, touched, emptied = None, [], []
        for run in self.runs:
            hits = self._hits(asked, run)
            held = None if hits is None else cut(hits.where("place = -1").select(*KEYS))
            if held is None or held.isEmpty():
                continue
            refs = self.run(run)
            left = refs.join(held, KEYS, "left_anti").select(*LINE)
            if left.isEmpty():
                emptied.append(run.version)
                continue
            touched.append(run.version)
            away = refs.join(held, KEYS, "left_semi").select(*LINE).distinct()
            vanished = away.join(left, LINE, "left_anti").withColumn("shard", _shard(run.shards))
            part = vanished.groupBy("shard").cogroup(self.filters(run).groupBy("shard")).applyInArrow(_drop, FILTERS)
            changed = part if changed is None else changed.unionByName(part)
        if changed is not None:
            changed.write.mode("overwrite").parquet(self._at("filters", version))
            keys.write.mode("overwrite").parquet(self._at("gone", version))
        if touched or emptied:
            self._commit("delete", 0, touched, emptied)

    def compact(self) -> None:
        """Merge all runs into one, without what was deleted."""
        if self.runs:
            self._write(self.refs, "compact")

    def dropped(self, batch: int | None = None) -> DataFrame:
        """k1, k2, places: the dropped places of every document (of a batch) that has any."""
        one = [run for run in self.runs if run.version == batch]
        if one:
            own = known = self.run(one[0]).where("place >= 0")
            earlier = [run for run in self.runs if run.version < batch]
            lines = cut(own.select(*LINE).distinct()) if earlier else None
            for run in earlier:
                hits = self._hits(lines, run)
                known = known if hits is None else known.unionByName(hits)
        else:
            known = self.refs
            own = known if batch is None else known.where(F.col("batch") == batch)
        own, known = (x.where("place >= 0").withColumn("who", _owner()) for x in (own, known))
        owners = known.groupBy(*LINE).agg(F.min("who").alias("owner"))
        return own.join(owners, LINE).where("who <> owner").groupBy(*KEYS).agg(F.collect_list("place").alias("places"))

    def texts(self, documents: DataFrame, batch: int | None = None) -> DataFrame:
        """doc_id, text without dropped lines, n_lines (not blank), n_dropped, for documents of the index.

        With ``batch``, the documents are those of one batch, and of earlier ones only possible hits are read.
        """
        rows = _documents(documents)
        if self.runs:
            joined = rows.join(cut(self.dropped(batch)), KEYS, "left").dropDuplicates(KEYS)
        else:
            joined = rows.dropDuplicates(KEYS).withColumn("places", F.lit(None).cast("array<int>"))
        lines = joined.select("doc_id", "text", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.split("text", "\n").alias("lines"))
        kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
        text = F.when(F.size("places") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
        told = F.filter("lines", lambda line: line.rlike(r"[^ \t\r]"))
        long = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
        return lines.select("doc_id", text.alias("text"), long(F.when(F.col("text").isNotNull(), F.size(told))).alias("n_lines"), long(F.size("places")).alias("n_dropped"))


def dedup_lines(documents: DataFrame, path: str, config: LineConfig = LineConfig()) -> DataFrame:
    """Insert all documents in a new index below ``path`` and return their texts without repeated lines."""
    index = LineIndex(documents.sparkSession, path, config)
    return index.texts(documents, index.insert(documents))


def dedup_in_parts(documents: DataFrame, path: str, config: LineConfig = LineConfig()) -> DataFrame:
    """The same for integer ids, as the index grows: in two parts by doc_id, of which the second is taken out and inserted again.

    The parts follow each other in the order of ids, so every line has the same owner as if all came at once.
    """
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    most, of = low + 3 * (high - low) // 4, F.col("doc_id")
    parts = [documents.where(of < most), documents.where((of >= most) | of.isNull())]
    index = LineIndex(documents.sparkSession, path, config)
    batches = [index.insert(part) for part in parts]
    index.delete(parts[-1])
    batches[-1] = index.insert(parts[-1])
    return reduce(DataFrame.unionByName, (index.texts(part, batch) for part, batch in zip(parts, batches, strict=True)))


def line_sql(documents: str = "documents") -> str:
    """DuckDB SQL of :func:`dedup_lines` and :func:`dedup_in_parts`."""
    return f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM {documents}),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS place FROM docs),
marked AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank,
    row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, place) AS nth
  FROM lines)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE blank OR nth = 1), '') AS text,
  count(*) FILTER (WHERE NOT blank)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT blank AND nth > 1)::BIGINT AS n_dropped
FROM marked GROUP BY doc_id, marked.text
UNION ALL SELECT doc_id, NULL, 0, 0 FROM docs WHERE text IS NULL
"""
