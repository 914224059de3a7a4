"""Semantic search over chunk embeddings: built-in functions, and dot products of blocks for many queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns
from ..runtime import ship
from ..sources.vocabulary import TokenizerModel


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_norm(vector: Column | str) -> Column:
    """The vector at length one; left alone within 0.999 and 1.001, and where it has no length."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    length = F.sqrt(dot(vector, vector))
    close = ((length > 0.999) & (length < 1.001)) | (length == 0)
    return F.when(close, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / length))


def top_k(vectors: DataFrame, query: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of the highest dot product with the single row of ``query`` (query); ties go to the smaller key.

    The query row is broadcast; each task keeps its best k before they are merged.  More than one row is an error: see
    :func:`top_k_each`.
    """
    one = query.limit(2).agg(F.collect_list(F.struct("query")).alias("rows"))
    many = F.raise_error(F.lit("top_k takes one query; use top_k_each")).cast(query.schema["query"].dataType)
    one = one.where("size(rows) > 0").select(F.when(F.size("rows") > 1, many).otherwise(F.col("rows")[0]["query"]).alias("query"))
    scored = vectors.crossJoin(F.broadcast(one)).select(key, dot(F.col(vector), F.col("query")).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = 8192) -> DataFrame:
    """query_id, rank, key, score: for every row of ``queries`` (query_id, query) its k vectors of the highest dot product.

    Ties go to the smaller key.  Every block of queries meets every block of vectors in a task of its own; the best k of
    each are merged.  Vectors without a value, or of another width than the query, are no candidates; query ids are unique.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    numbers = lambda rows, id, v: rows.select(F.col(id).alias("id"), F.col(v).cast("array<double>").alias("v")).where("NOT exists(v, x -> x IS NULL)")
    left, right = numbers(vectors, key, vector), numbers(queries, "query_id", "query")
    lefts, rights = (max(1, -(-rows.count() // block)) for rows in (left, right))
    spot = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("*", spot(lefts).alias("a"), copies(rights).alias("b"), F.size("v").alias("width"))
    right = right.select("*", copies(lefts).alias("a"), spot(rights).alias("b"), F.size("v").alias("width"))
    ship(vectors.sparkSession)
    ids = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}"
    groups = left.groupBy("a", "b", "width").cogroup(right.groupBy("a", "b", "width"))
    best = groups.applyInArrow(lambda x, y: _best(x, y, k, key), f"{ids}, score double")
    nth = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key).asc_nulls_last())
    return best.select("query_id", F.row_number().over(nth).cast("long").alias("rank"), key, "score").where(F.col("rank") <= k)


def _best(vectors: pa.Table, queries: pa.Table, k: int, key: str) -> pa.Table:
    """The best k of some vectors for each of some queries, scored in the order of the places, so that equal vectors tie."""
    vectors = vectors.sort_by("id")
    n, m = len(vectors), len(queries)
    v, q = (pc.list_flatten(t["v"]).to_numpy().reshape(len(t), -1) if len(t) else np.zeros((0, 0)) for t in (vectors, queries))
    rows, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if n and m:
        k = min(k, n)
        slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1).max())
        for i in range(0, m, 256):
            rough = q[i : i + 256] @ v.T
            least = np.partition(rough, n - k, axis=1)[:, n - k] - slack[i : i + 256]
            row, at = np.nonzero(rough >= least[:, None])
            score = np.zeros(len(row))
            for place in range(q.shape[1]):
                score += v[at, place] * q[i + row, place]
            by = np.lexsort((at, -score, row))
            row, at, score = row[by], at[by], score[by]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            rows.append(i + row[nth < k])
            found.append(at[nth < k])
            scores.append(score[nth < k])
    row, at = np.concatenate(rows), np.concatenate(found)
    return pa.table({"query_id": queries["id"].take(pa.array(row)), key: vectors["id"].take(pa.array(at)), "score": np.concatenate(scores)})


def passages(texts: DataFrame, model: TokenizerModel, tokens_per_input: int, stride: int = 0) -> DataFrame:
    """key, chunk, passage: the source text of every chunk of (key, text), from its offset to the next one's.

    Passages are cut where the text is, so keys may be null or repeated and nothing is joined.  They come from the text in
    the model's normal form, to which offsets refer.
    """
    cut = columns.passages("text", model, tokens_per_input, stride)
    return texts.select("key", F.posexplode(cut).alias("chunk", "passage"))


def encode_query(text: Column | str, model: TokenizerModel, prefix: str = "", max_tokens: int = 512, pad_to: int | None = 512) -> Column:
    """A query as the encoder wants it: the model's prompt before it, padded.  A null query gives null fields."""
    text = F.col(text) if isinstance(text, str) else text
    return columns.encode(F.concat(F.lit(prefix), text), model, max_tokens, pad_to)


def pending(texts: DataFrame, done: DataFrame) -> DataFrame:
    """The texts whose last chunk (null next_offset) isn't stored yet."""
    finished = done.where("next_offset IS NULL").select("key").distinct()
    return texts.join(finished, "key", "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``fresh`` put in place of those with the same keys.

    Of equal keys within ``fresh`` one row counts: the last in the order of all other columns.
    """
    others = [c for c in fresh.columns if c not in keys]
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in others))
    rows = fresh.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth") if others else fresh.distinct()
    marks = rows.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [stored[k].eqNullSafe(marks[f"_{k}"]) for k in keys]
    return stored.join(marks, same, "left_anti").unionByName(rows)
