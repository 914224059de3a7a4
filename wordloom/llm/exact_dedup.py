"""Exact deduplication by skew-safe combining.

Texts are compared in three stages, each over their full content:

1. every task combines its own rows of equal (digest, text) — Spark's map-side
   aggregation, before anything is shuffled;
2. the tasks' winners are merged by (digest, salt, text); the salt is the
   number of the task modulo ``salts``, so the winners of one copied text meet
   in ``salts`` places and not in one;
3. the salt winners, at most ``salts`` a text, are merged by (digest, text).

Every digest is salted, whatever the number of its copies.  Documents find their
winner by digest and a second hash, ids only; where two contents share both
(which a count of winners shows), those documents are grouped by the text itself.

Defined results: null texts equal each other and differ from the empty text.
The first of equal texts by doc_id (null last) is kept and names the group.
Rows of equal doc_id and text are one document and listed once, with ``n_rows``;
other columns don't matter for equality and are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, fingerprint


def content_digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def content_check(text: Column) -> Column:
    return fingerprint(text)


@dataclass(frozen=True)
class ExactConfig:
    salts: int = 32
    digest: Callable[[Column], Column] = content_digest
    check: Callable[[Column], Column] = content_check


def winners(documents: DataFrame, config: ExactConfig) -> DataFrame:
    """(digest, check, first): one row for each distinct content; ``first`` is its least doc_id, null where it has none."""
    rows = documents.select("doc_id", "text", config.digest(F.col("text")).alias("digest"), (F.spark_partition_id() % config.salts).alias("salt"))
    merged = rows.groupBy("digest", "salt", "text").agg(F.min("doc_id").alias("first"))
    found = merged.groupBy("digest", "text").agg(F.min("first").alias("first"))
    return found.select("digest", config.check(F.col("text")).alias("check"), "first")


def exact_groups(documents: DataFrame, config: ExactConfig = ExactConfig()) -> DataFrame:
    """doc_id, keeper_id, keep, n_rows: one row for every distinct (doc_id, text)."""
    text = F.col("text")
    keyed = documents.select("doc_id", config.digest(text).alias("digest"), config.check(text).alias("check"))
    ids = keyed.groupBy("doc_id", "digest", "check").agg(F.count("*").alias("n_rows"))
    won = cut(winners(documents, config))
    one = won.groupBy("digest", "check").agg(F.min("first").alias("first"), F.count("*").alias("contents"))
    one = one.select(F.col("digest").alias("_d"), F.col("check").alias("_c"), "first", "contents")
    joined = ids.join(one, ids["digest"].eqNullSafe(F.col("_d")) & (ids["check"] == F.col("_c")))
    found = joined.where("contents = 1").select("doc_id", "first", "n_rows")
    clash = cut(one.where("contents > 1").select("_d", "_c"))
    if not clash.isEmpty():
        texts = documents.select("doc_id", "text", config.digest(text).alias("digest"), config.check(text).alias("check"))
        texts = texts.join(clash, texts["digest"].eqNullSafe(F.col("_d")) & (texts["check"] == F.col("_c")), "left_semi")
        texts = texts.groupBy("doc_id", "text").agg(F.count("*").alias("n_rows"))
        first = texts.groupBy(F.col("text").alias("_t")).agg(F.min("doc_id").alias("first"))
        found = found.unionByName(texts.join(first, texts["text"].eqNullSafe(F.col("_t"))).select("doc_id", "first", "n_rows"))
    return found.select("doc_id", F.col("first").alias("keeper_id"), F.col("doc_id").eqNullSafe(F.col("first")).alias("keep"), "n_rows")


def exact_sql(documents: str = "documents") -> str:
    """DuckDB SQL of :func:`exact_groups`."""
    return f"""
SELECT doc_id, keeper_id, doc_id IS NOT DISTINCT FROM keeper_id AS keep, n_rows
FROM (SELECT doc_id, count(*) AS n_rows, min(doc_id) OVER (PARTITION BY text) AS keeper_id FROM {documents} GROUP BY doc_id, text)
"""
