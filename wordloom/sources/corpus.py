"""Corpora as (key, text) DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread


def parquet_texts(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text of a Parquet table; only those two columns are read."""
    return spread(spark.read.parquet(path).select(F.col(key).alias("key"), F.col(text).alias("text")))


def json_map_texts(spark: SparkSession, path: str) -> DataFrame:
    """key, text of JSON files that each hold one object of integer keys and texts."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "text")).withColumn("key", F.col("key").cast("int"))


def stream_texts(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", files_per_trigger: int = 64) -> DataFrame:
    """key, text of Parquet files as they arrive below ``path`` (a folder, or one file)."""
    schema = spark.read.parquet(path).select(key, text).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):
        folder, name = os.path.split(path)
        stream = stream.option("pathGlobFilter", name)
        path = folder
    return stream.parquet(path).select(F.col(key).alias("key"), F.col(text).alias("text"))
