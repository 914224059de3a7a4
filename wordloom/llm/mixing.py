"""Mixing sources to target weights by capped water-filling.

A source of b bytes may give at most ``max_epochs`` * b bytes.  Sources whose
share of the budget exceeds that are clamped, and what they leave is given to
the others in proportion to their weights, until no source exceeds its cap.
Ordered by cap over weight, the clamped sources are a prefix, so the fixed point
is a running sum over the table of sources (one row a source).

A source's epochs e then give every document floor(e) whole copies, and one more
where a seeded uniform number of the document lies below the fraction of e.

Target weights are a table (source, weight), or an expression over a source and
its bytes, such as :data:`ROOT`, by which large sources count less than they are
large.

Defined results: the budget is ``budget_epochs`` times the bytes of all
documents of sources that have a weight, or the sum of the caps if that is less.  Without given weights all
sources weigh the same.  Sources that a table of weights lacks, and weights that
are null or not above 0, give nothing; of several weights of a source the
largest counts.  A null source is a source.  Null or empty texts have no bytes
but are sampled as their source is; a source of no bytes at all gives nothing.
Repeated rows draw the same number.  Other columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, spare


@dataclass(frozen=True)
class MixConfig:
    """``broadcast_sources``: up to so many sources the plan is broadcast; beyond that every source is joined in ``salts`` places."""

    max_epochs: int = 4
    budget_epochs: float = 1.0
    seed: int = 7
    broadcast_sources: int = 100_000
    salts: int = 64


#: Weights by the root of a source's bytes, as an SQL expression that Spark and DuckDB share.
ROOT = "sqrt(bytes)"
#: All sources alike.
EQUAL = "CAST(1 AS DOUBLE)"

Weights = DataFrame | str


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed, the id and the text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def water_fill(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """source, bytes, weight, share (bytes to give), epochs — from one row a source with source, bytes, weight."""
    live = sizes.where("weight > 0 AND bytes > 0")
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.least(F.lit(config.budget_epochs) * F.sum("bytes").over(everything), F.sum("cap").over(everything))
    filled = (
        live.withColumn("cap", (F.col("bytes") * config.max_epochs).cast("double"))
        .withColumn("budget", budget)
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("rest"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    )
    share = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return filled.select("source", "bytes", "weight", share.alias("share"), (share / F.col("bytes")).alias("epochs"))


def plan(documents: DataFrame, weights: Weights = EQUAL, config: MixConfig = MixConfig()) -> DataFrame:
    """Epochs of each source of ``documents``; ``weights`` is a table of source, weight, or SQL over source and bytes."""
    sizes = documents.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    if isinstance(weights, str):
        sizes = sizes.withColumn("weight", F.expr(weights).cast("double"))
    else:
        given = weights.groupBy(F.col("source").alias("_of")).agg(F.max("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("_of"))).select("source", "bytes", "weight")
    return water_fill(sizes, config)


def _copies(documents: DataFrame, weights: Weights, config: MixConfig, epochs: str, copy: str) -> DataFrame:
    found = cut(plan(documents, weights, config))
    of = spare(documents, "of")
    found = found.select(F.col("source").alias(of), F.col("epochs").alias(epochs))
    same = documents["source"].eqNullSafe(F.col(of))
    if found.count() <= config.broadcast_sources:
        rows = documents.join(F.broadcast(found), same).drop(of)
    else:
        salt, own = spare(documents, "salt"), spare(documents, "own_salt")
        found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))))
        salted = documents.withColumn(own, F.pmod(F.xxhash64("doc_id", "text"), F.lit(config.salts)).cast("int"))
        rows = salted.join(found, same & (F.col(own) == F.col(salt))).drop(of, own, salt)
    whole = F.floor(epochs).cast("int")
    times = whole + (uniform(F.col("doc_id"), F.col("text"), config.seed) < F.col(epochs) - whole).cast("int")
    return rows.withColumn(copy, times).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))


def sample_list(documents: DataFrame, weights: Weights = EQUAL, config: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, source, epochs, copy: one row for every repetition of every sampled document."""
    rows = documents.select("doc_id", "source", "text")
    return _copies(rows, weights, config, "epochs", "copy").select("doc_id", "source", F.round("epochs", 6).alias("epochs"), F.col("copy").cast("long").alias("copy"))


def mix(documents: DataFrame, weights: Weights = EQUAL, config: MixConfig = MixConfig()) -> DataFrame:
    """The sampled documents themselves, repeated, with the columns they came with."""
    epochs, copy = spare(documents, "epochs"), spare(documents, "copy")
    return _copies(documents, weights, config, epochs, copy).drop(epochs, copy)


def mix_sql(documents: str = "documents", weights: str = EQUAL, config: MixConfig = MixConfig(), columns: str = "doc_id, source, round(epochs, 6) AS epochs, copy") -> str:
    """DuckDB SQL of :func:`sample_list` with weights by expression."""
    return f"""
WITH bytes_of AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM {documents} GROUP BY source),
sizes AS (SELECT *, ({weights})::DOUBLE AS weight FROM bytes_of),
live AS (SELECT *, (bytes * {config.max_epochs})::DOUBLE AS cap FROM sizes WHERE bytes > 0 AND weight > 0),
levels AS (
  SELECT *, least({config.budget_epochs}::DOUBLE * sum(bytes) OVER (), sum(cap) OVER ()) AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM live),
filled AS (
  SELECT *, max(CASE WHEN (budget - spent) / rest * weight <= cap THEN (budget - spent) / rest END) OVER () AS final FROM levels),
epochs AS (SELECT source AS of, least(cap, coalesce(final * weight, cap)) / bytes AS epochs FROM filled),
drawn AS (
  SELECT d.*, e.epochs, floor(e.epochs)::BIGINT + CASE WHEN
    ('0x' || substr(md5('{config.seed}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE
    < e.epochs - floor(e.epochs) THEN 1 ELSE 0 END AS times
  FROM {documents} d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.of)
SELECT {columns} FROM (SELECT *, unnest(generate_series(1, times)) AS copy FROM drawn)
"""
