"""Structured Streaming forms: the same stateless transformations on a stream, and an idempotent sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import batches, search
from ..runtime import remove, scratch
from ..sources.vocabulary import TokenizerModel


def chunk_stream(texts: DataFrame, model: TokenizerModel, tokens_per_input: int, stride: int, out: str, once: bool = True) -> StreamingQuery:
    """Chunk a stream of (key, text) into Parquet below ``out``; exactly once, through the file sink's log."""
    writer = batches.chunk_rows(texts, model, tokens_per_input, stride).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", os.path.join(out, "rows")).option("checkpointLocation", os.path.join(out, "checkpoint"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(rows: DataFrame, keys: list[str], out: str, once: bool = True) -> StreamingQuery:
    """Keep the newest row of each key below ``out``; read it with :func:`upserted`.

    A micro-batch writes its own rows only, one a key, into a folder named by its
    number, so a batch that is run again overwrites what it wrote before, and the
    work follows the batch and not the table.
    """

    def save(batch: DataFrame, number: int) -> None:
        search.upsert(batch.limit(0), batch, keys).write.mode("overwrite").parquet(os.path.join(out, "changes", f"number={number}"))

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", os.path.join(out, "checkpoint"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def upserted(spark: SparkSession, keys: list[str], out: str) -> DataFrame:
    """The newest row of each key that :func:`upsert_stream` wrote below ``out``."""
    rows = spark.read.option("basePath", os.path.join(out, "changes")).parquet(os.path.join(out, "changes", "number=*"))
    newest = Window.partitionBy(*keys).orderBy(F.col("number").desc())
    return rows.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth", "number")


def compact(spark: SparkSession, keys: list[str], out: str) -> None:
    """Put all changes so far into one; call it between runs of the stream.

    The merged rows replace the last change, so that those of later batches stay newer, and earlier ones are deleted.
    """
    folders = sorted(int(r.number) for r in _numbers(spark, out))
    if len(folders) < 2:
        return
    spare = os.path.join(out, "merged")
    upserted(spark, keys, out).write.mode("overwrite").parquet(spare)
    at = lambda n: os.path.join(out, "changes", f"number={n}")
    spark.read.parquet(spare).write.mode("overwrite").parquet(at(folders[-1]))
    for number in folders[:-1]:
        remove(spark, at(number))
    remove(spark, spare)


def _numbers(spark: SparkSession, out: str) -> list:
    rows = spark.read.option("basePath", os.path.join(out, "changes")).parquet(os.path.join(out, "changes", "number=*"))
    return rows.select("number").distinct().collect()


def work_folder(df: DataFrame, name: str) -> str:
    """A new folder for a stream's output that all executors share; it goes when this program ends."""
    return scratch(df.sparkSession, name)
