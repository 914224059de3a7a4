"""Chunk rows and fixed-size batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import columns
from ..runtime import cut, map_batches
from ..sources.vocabulary import TokenizerModel


def chunk_rows(texts: DataFrame, model: TokenizerModel, tokens_per_input: int, stride: int = 0, **options) -> DataFrame:
    """key, chunk, offset, next_offset, n_tokens, input_ids, truncated_tail — one row a chunk of (key, text).

    Works on streams; a null text has no chunk.
    """
    found = texts.select("key", F.posexplode(columns.chunks("text", model, tokens_per_input, stride, **options)).alias("chunk", "c"))
    return found.select("key", "chunk", "c.*")


def number_rows(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """``df`` with a gapless number from 0 in the order of unique columns, without gathering it in one task.

    Rows are range-partitioned and numbered in each partition; the partitions'
    sizes, one row each, give the numbers at which they start.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = pa.array(np.arange(seen, seen + batch.num_rows, dtype=np.int64))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, at], [*batch.schema.names, "_at"])

    placed = cut(map_batches(ranged, run, StructType([*ranged.schema.fields, StructField("_at", LongType())])))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    begin = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", begin.alias("_begin"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_begin") + F.col("_at")).drop("_part", "_at", "_begin")


def batch_rows(chunks: DataFrame, batch_size: int, tokens_per_input: int) -> DataFrame:
    """batch_id, row_in_batch and the chunk's columns, in the order of keys (null first), a document's chunks together.

    Keys may be null or repeated; documents of equal keys follow each other.
    The rows that the last batch lacks have null columns and zeros for ids.
    The chunks are written once to the shared folder, so they aren't tokenized
    again; then only keys and row numbers are sorted, and ids are joined to
    their places by the row, not the key.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    names = chunks.columns
    chunks = cut(chunks.withColumn("_id", F.monotonically_increasing_id()))
    # chunks of a document come one after the other, so this is the same number for all of them
    document = (F.col("_id") - F.col("chunk")).alias("_document")
    places = number_rows(chunks.select("key", document, "_id"), ["key", "_document", "_id"])
    full = F.floor(F.col("row") / batch_size)
    placed = places.select("_id", full.alias("batch_id"), (F.col("row") % batch_size).cast("int").alias("row_in_batch"))
    rows = chunks.join(placed, "_id")
    last = places.agg(F.count("*").alias("n")).where(F.col("n") % batch_size > 0)
    tail = last.select(F.floor(F.col("n") / batch_size).alias("batch_id"), F.explode(F.sequence((F.col("n") % batch_size).cast("int"), F.lit(batch_size - 1))).alias("row_in_batch"))
    empty = F.array_repeat(F.lit(0).cast("bigint"), tokens_per_input).alias("input_ids")
    tail = tail.select("batch_id", "row_in_batch", *(empty if c == "input_ids" else F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in names))
    return rows.select("batch_id", "row_in_batch", *names).unionByName(tail)


def partition_batches(texts: DataFrame, model: TokenizerModel, batch_size: int, tokens_per_input: int, stride: int = 0, degree: int | None = None) -> DataFrame:
    """partition, batch, row_in_batch and the chunk's columns of (key, text): full batches without a common order or a shuffle.

    Every task fills batches of its own, numbered from 0, in one pass; the last
    one of each is filled up as in :func:`batch_rows`.  ``degree`` is the number
    of tasks; without it there are as many as the input has partitions.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    texts = texts if degree is None else texts.repartition(degree)
    chunks = chunk_rows(texts, model, tokens_per_input, stride)
    schema = StructType([StructField("partition", IntegerType()), StructField("batch", LongType()), StructField("row_in_batch", IntegerType()), *(StructField(f.name, f.dataType) for f in chunks.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, like = 0, None
        here = TaskContext.get().partitionId()
        for batch in batches:
            at = np.arange(seen, seen + batch.num_rows)
            seen, like = seen + batch.num_rows, batch.schema
            yield pa.RecordBatch.from_arrays([*places(here, at), *batch.columns], schema.names)
        if seen % batch_size:
            at = np.arange(seen, -(-seen // batch_size) * batch_size)
            zeros = pa.array([[0] * tokens_per_input] * len(at), like.field("input_ids").type)
            rest = [zeros if f.name == "input_ids" else pa.nulls(len(at), f.type) for f in like]
            yield pa.RecordBatch.from_arrays([*places(here, at), *rest], schema.names)

    def places(here: int, at: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.full(len(at), here), pa.int32()), pa.array(at // batch_size), pa.array(at % batch_size, pa.int32())]

    return map_batches(chunks, run, schema)


def packed(batches: DataFrame) -> DataFrame:
    """One row a batch: its rows in order as (key, offset, next_offset) and one flat list of ids."""
    row = F.struct("row_in_batch", "key", "offset", "next_offset", "input_ids")
    rows = batches.groupBy("batch_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select(
        "batch_id",
        F.transform("rows", lambda r: F.struct(r["key"].alias("key"), r["offset"].alias("offset"), r["next_offset"].alias("next_offset"))).alias("correlation"),
        F.flatten(F.transform("rows", lambda r: r["input_ids"])).alias("input_ids"),
    )
