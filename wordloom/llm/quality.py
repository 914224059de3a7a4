"""Supervised subword embeddings as a document quality classifier.

The model is a bag of hashed features: words (runs of non-space bytes, case and
punctuation kept), ordered word bigrams and character n-grams of words, which
may take in the space before or behind.  Every
feature has a learned vector; a document is the mean of its features' vectors,
followed by a softmax layer.  Training is plain stochastic gradient descent in
numpy over a bounded sample of labelled documents (``max_train_docs`` rows a class).
The sample is drawn among the labels whose documents are in the table, so
labels of other documents change nothing.

Scoring uses that mean and output layer are linear: the two collapse into one
number a feature bucket, so a document costs one table look-up a feature.

Defined results: a null, empty or blank text has no feature; it scores 0 and is
rejected.  Without labelled documents of both classes there is no model: a
warning is given, and every text with a feature has a null score and is kept.
Contradicting labels of a document count by majority, ties as good; null labels
are ignored.  Rows equal in doc_id and text are one training row.  Every input
row gives one output row, repeated rows alike.  doc_id may have any type that
labels can be joined on.  Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..runtime import map_batches
from . import kernels as K
from .tables import cut, spare

_SPACE = np.zeros(256, dtype=bool)
for _c in b" \t\n\r\x0b\x0c":
    _SPACE[_c] = True


@dataclass(frozen=True)
class QualityConfig:
    """``max_train_docs``: labelled rows of the documents used of each class; the only bound on what is read."""

    bits: int = 17
    dim: int = 16
    char_grams: tuple[int, ...] = (3, 4)
    epochs: int = 12
    rate: float = 1.0
    max_train_docs: int = 1000
    seed: int = 11
    threshold: float = 0.5


def features(column: pa.Array, config: QualityConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket ids, row offsets) for each kind of feature."""
    data, offsets = K.raw(column)
    space = _SPACE[data]
    start, end = K.spans(data, offsets, ~space)
    words = K.hash_spans(data, start, end)
    doc = np.searchsorted(start, offsets, side="left")
    shift = np.uint64(64 - config.bits)
    out = [((words >> shift).astype(np.int32), doc)]
    if len(words) > 1:
        pair = words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:]
        inside = np.ones(len(pair), dtype=bool)
        edge = doc[1:-1] - 1
        inside[edge[(edge >= 0) & (edge < len(pair))]] = False
        pair = pair[inside]
        count = np.concatenate(([0], np.cumsum(np.maximum(np.diff(doc) - 1, 0))))
        out.append(((K.mix(pair ^ np.uint64(0xA24BAED4963EE407)) >> shift).astype(np.int32), count))
    low = data.astype(np.uint32)
    low[space] = 32
    blank = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
    for n in config.char_grams:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        code = np.full(m, n, dtype=np.uint32)
        for k in range(n):
            code *= np.uint32(0x01000193)
            code ^= low[k : k + m]
        code *= np.uint32(0x9E3779B1)
        code >>= np.uint32(32 - config.bits)
        good = (blank[n - 1 : n - 1 + m] - blank[1 : 1 + m]) == 0
        for back in range(1, n):
            cross = offsets[1:-1] - back
            good[cross[(cross >= 0) & (cross < m)]] = False
        at = np.flatnonzero(good)
        out.append((code[at].astype(np.int32), np.searchsorted(at, offsets, side="left")))
    return out


def train(texts: pa.Array, labels: np.ndarray, config: QualityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature vectors, output layer and bias."""
    rng = np.random.default_rng(config.seed)
    buckets = 1 << config.bits
    docs = []
    for a, b in K.slices(texts):
        kinds = features(texts.slice(a, b - a), config)
        for i in range(b - a):
            ids = np.concatenate([f[o[i] : o[i + 1]] for f, o in kinds])
            unique, count = np.unique(ids, return_counts=True)
            docs.append((unique, (count / max(1, len(ids))).astype(np.float32)))
    vectors = rng.uniform(-1 / config.dim, 1 / config.dim, (buckets, config.dim)).astype(np.float32)
    output = np.zeros((config.dim, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    steps, step = config.epochs * len(docs), 0
    for _ in range(config.epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            if len(ids) == 0:
                continue
            rate = config.rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = output @ p
            output -= np.float32(rate) * np.outer(hidden, p).astype(np.float32)
            bias -= np.float32(rate * 0.1) * p
            # a feature's gradient is its share; scaled up, as shares in long documents are tiny
            vectors[ids] -= np.float32(rate * 20) * np.outer(share, back).astype(np.float32)
    return vectors, output, bias


def collapsed(vectors: np.ndarray, output: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Margin of good over bad for each bucket; the bias is the last entry."""
    return np.append(vectors @ (output[:, 1] - output[:, 0]), bias[1] - bias[0]).astype(np.float32)


def score(column: pa.Array, margin: np.ndarray | None, config: QualityConfig) -> np.ndarray:
    """Probability of good for each text; 0 where there is no feature, else NaN where there is no model."""
    out = np.zeros(len(column))
    for a, b in K.slices(column):
        total, count = np.zeros(b - a), np.zeros(b - a, dtype=np.int64)
        for ids, offsets in features(column.slice(a, b - a), config):
            if margin is not None:
                total += K.segment_sum(margin[ids], offsets)
            count += np.diff(offsets)
        if margin is None:
            p = np.full(b - a, np.nan)
        else:
            p = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + margin[-1], -50, 50)))
        out[a:b] = np.where(count > 0, p, 0.0)
    return out


def training_rows(documents: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, label, pick, text: at most ``max_train_docs`` different labelled rows a class, the first by (pick, doc_id, text).

    Only ids meet the labels; texts are fetched for the ids chosen, and then the
    bound is taken again on rows, as one id may have many texts.
    """
    votes = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label"))
    )
    ids = documents.where("doc_id IS NOT NULL").select("doc_id").join(votes, "doc_id").distinct()
    ids = ids.withColumn("pick", F.xxhash64("doc_id", F.lit(config.seed)))
    first = lambda df, value, *order: df.where(F.col("label") == value).orderBy("pick", "doc_id", *order).limit(config.max_train_docs)
    chosen = cut(first(ids, 0).unionByName(first(ids, 1)))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "pick", "text").distinct()
    rows = cut(rows)
    return first(rows, 0, "text").unionByName(first(rows, 1, "text"))


def fit(documents: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> np.ndarray | None:
    """Train in one task; only the weights reach the driver.  None, and a warning, where a class has no labelled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        t = pa.Table.from_batches(found).sort_by([("pick", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        y = np.asarray(t["label"].combine_chunks(), dtype=np.int64)
        if len(set(y.tolist())) < 2:
            return
        margin = collapsed(*train(t["text"].combine_chunks(), y, config))
        yield pa.RecordBatch.from_arrays([pa.array([margin.tobytes()], pa.binary())], ["margin"])

    got = map_batches(training_rows(documents, labels, config).repartition(1), run, "margin binary").collect()
    if not got:
        warnings.warn("no document is labelled good, or none bad: the quality classifier has no model and keeps every text", stacklevel=3)
        return None
    return np.frombuffer(bytes(got[0]["margin"]), dtype=np.float32)


def _scored(df: DataFrame, margin: np.ndarray | None, config: QualityConfig, name: str) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(margin)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(batch.column(columns.index("text")), model.value, config)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64(), from_pandas=True)], [*columns, name])

    return map_batches(df, run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def _kept(quality: str, config: QualityConfig) -> Column:
    return F.coalesce(F.col(quality) >= config.threshold, F.lit(True))


def classify(documents: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, quality (probability of good, null without a model), keep — one row for every document."""
    margin = fit(documents, labels, config)
    return (
        _scored(documents.select("doc_id", "text"), margin, config, "quality")
        .select("doc_id", F.round("quality", 6).alias("quality"), _kept("quality", config).alias("keep"))
    )


def keep_good(documents: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows whose text the classifier accepts, with the columns they came with."""
    margin = fit(documents, labels, config)
    name = spare(documents, "quality")
    return _scored(documents, margin, config, name).where(_kept(name, config)).drop(name)
