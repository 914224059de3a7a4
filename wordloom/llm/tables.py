"""Tables, lineage cuts and row identity shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..runtime import cut, shared_dir, spread

__all__ = ["cut", "fingerprint", "kind", "row_key", "shared_dir", "spare", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``sf_dir``; documents are spread over all cores if they lie in few files."""
    rows = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(rows) if name == "documents" else rows


def fingerprint(*columns: str | Column) -> Column:
    """64-bit hash of columns that also tells nulls and empty strings apart."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def kind(df: DataFrame, name: str) -> str:
    """The type of a column as SQL writes it."""
    return df.schema[name].dataType.simpleString()


def _comparable(df: DataFrame, name: str) -> Column:
    """A column as something that can be hashed: maps by their sorted entries, or as JSON where they lie deeper."""
    column, of = F.col(f"`{name}`"), df.schema[name].dataType
    if "map<" not in of.simpleString():
        return column
    if isinstance(of, MapType) and "map<" not in of.keyType.simpleString() + of.valueType.simpleString():
        return F.array_sort(F.map_entries(column))
    return F.to_json(F.struct(column))


def row_key(df: DataFrame, seed: int | None = None) -> Column:
    """Hash over every column; rows that share those of two seeds are repetitions of one row."""
    return fingerprint(*([] if seed is None else [F.lit(seed)]), *(_comparable(df, c) for c in df.columns))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
