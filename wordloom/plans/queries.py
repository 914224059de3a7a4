"""Registered queries over the library's operators; each runs over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import batches as B
from ..operators import search as S
from ..operators import words as W
from ..runtime import spread
from ..sources import corpus
from ..sources.vocabulary import load_vocab_txt
from ..streaming import streams
from .fixture import model, vocab_lines

PROMPT = "represent this sentence for searching relevant passages: "
SIZE, STRIDE, BATCH = 128, 25, 32


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.parquet_texts(spark, f"{sf_dir}/documents.parquet")


def _joined(ids) -> F.Column:
    return F.array_join(ids.cast("array<string>"), " ")


def _counted(df: DataFrame, key: str | list[str], ids) -> DataFrame:
    key = [key] if isinstance(key, str) else key
    rows = df.select(*key, ids.alias("ids"))
    return rows.select(*key, F.size("ids").cast("long").alias("n_tokens"), _joined(F.col("ids")).alias("ids"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per language of the documents, each cut at 512."""
    rows = _documents(spark, sf_dir, "lang").select("lang", F.size(C.token_ids("text", model(), 512)).cast("long").alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("n_tokens"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model().vocab(spark)


def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of the vocabulary and the ids beside it, which have no token."""
    ids = model().vocab(spark).agg(F.explode(F.sequence(F.lit(-1).cast("long"), F.max("id").cast("long") + 1)).alias("id"))
    return C.lookup(ids, model())


def pretokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the generator keeps the filter from being pushed below, where texts would be cut a second time
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(F.array(C.segments("text", model()))).alias("s")).where(F.size("s") > 0)
    starts = F.transform("s.start", lambda x: x.cast("string"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s.segment", " ").alias("segments"), F.array_join(starts, " ").alias("starts"))


def word_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = W.word_counts(_documents(spark, sf_dir))
    noisy = F.concat(F.lit("​�"), F.col("word"), F.lit("\u0000"))
    low = C.lower_simple("word")
    return counted.select("word", low.alias("low"), C.normalize_unicode(C.strip_accents(low), "NFC").alias("bare"), C.drop_controls(noisy).alias("clean"), "n")


def wordpiece_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _documents(spark, sf_dir).select(F.explode(W.segment_array("text")).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.select("word", _joined(C.word_pieces("word", model())).alias("ids"))


def encode_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_documents(spark, sf_dir), "doc_id", C.token_ids("text", model(), None))


def encode_memoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.encode_memoised(_texts(spark, sf_dir), model())
    return _counted(rows.withColumnRenamed("key", "doc_id"), "doc_id", F.col("input_ids"))


def encode_truncated_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_documents(spark, sf_dir), "doc_id", C.token_ids("text", model(), 512))


def encode_truncated_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_documents(spark, sf_dir), "doc_id", C.token_ids("text", model(), 32))


def encode_padded_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", C.encode("text", model(), SIZE, pad_to=SIZE).alias("e"))
    return rows.select("doc_id", *(_joined(F.col(f"e.{c}")).alias(c) for c in ("input_ids", "attention_mask", "token_type_ids")))


def chat_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a whole."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    return _counted(turns, ["conv_id", "turn"], C.token_ids("text", model(), None))


def _chunk_columns(rows: DataFrame) -> DataFrame:
    ids = _joined(F.slice("input_ids", F.lit(1), F.col("n_tokens")))
    return rows.select(
        F.col("key").alias("doc_id"),
        F.col("chunk").cast("long").alias("chunk"),
        F.col("offset").cast("long").alias("offset"),
        F.col("next_offset").cast("long").alias("next_offset"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        ids.alias("ids"),
        "truncated_tail",
    )


def chunk_stride0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(B.chunk_rows(_texts(spark, sf_dir), model(), SIZE))


def chunk_stride25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(B.chunk_rows(_texts(spark, sf_dir), model(), SIZE, STRIDE))


def chunk_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(B.chunk_rows(_texts(spark, sf_dir), model(), 27))


def chunk_333_stride77(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(B.chunk_rows(_texts(spark, sf_dir), model(), 333, 77))


def chunk_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposed texts for a model that composes them: offsets are those of the composed text."""
    texts = _texts(spark, sf_dir).withColumn("text", C.normalize_unicode("text", "NFD"))
    return _chunk_columns(B.chunk_rows(texts, model("NFC"), SIZE))


def chunk_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with ligatures and wide letters for a model that takes these apart."""
    texts = _texts(spark, sf_dir).withColumn("text", F.translate(F.replace("text", F.lit("fi"), F.lit("\ufb01")), "aeR", "\uff41\uff45\uff32"))
    return _chunk_columns(B.chunk_rows(texts, model("NFKC"), SIZE))


def encode_vocab_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocab.txt written to the shared folder and loaded from there; special tokens in texts are unknown to it."""
    path = streams.work_folder(spark.range(1), "vocab")
    lines = spark.createDataFrame([("\n".join(vocab_lines()),)], "value string")
    lines.coalesce(1).write.text(path)
    own = load_vocab_txt(path, True, spark)
    return _counted(_marked(_documents(spark, sf_dir)), "doc_id", C.token_ids("text", own, None))


def _marked(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", F.concat(F.lit("doc[CLS]"), F.col("doc_id").cast("string"), F.lit("[SEP]end "), F.col("text")))


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document twice; the smallest id is null."""
    texts = _texts(spark, sf_dir)
    texts = texts.crossJoin(F.broadcast(texts.agg(F.min("key").alias("least")))).select(F.nullif("key", "least").alias("key"), "text")
    return texts.unionByName(texts)


def batches_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch_columns(B.batch_rows(B.chunk_rows(_twice(spark, sf_dir), model(), SIZE), BATCH, SIZE))


def passages_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passage_columns(S.passages(_twice(spark, sf_dir), model(), SIZE))


def memoised_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(W.encode_memoised(_twice(spark, sf_dir), model()).withColumnRenamed("key", "doc_id"), "doc_id", F.col("input_ids"))


def partition_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks from the batches of each task, and how many rows their batch has."""
    rows = B.partition_batches(_texts(spark, sf_dir), model(), BATCH, SIZE)
    size = F.count("*").over(Window.partitionBy("partition", "batch"))
    long = [F.col(c).cast("long").alias(c) for c in ("chunk", "offset", "n_tokens")]
    return rows.withColumn("rows_of_batch", size).where("chunk IS NOT NULL").select(F.col("key").alias("doc_id"), *long, "rows_of_batch")


def prompt_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as queries for an encoder that wants a prompt before them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", S.encode_query("text", model(), PROMPT, 64, 64).alias("e"))
    return items.select("item_id", *(_joined(F.col(f"e.{c}")).alias(c) for c in ("input_ids", "attention_mask", "token_type_ids")))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.batch_rows(B.chunk_rows(_texts(spark, sf_dir), model(), SIZE), BATCH, SIZE)
    return _batch_columns(rows)


def _batch_columns(rows: DataFrame) -> DataFrame:
    long = [F.col(c).cast("long").alias(c) for c in ("batch_id", "row_in_batch", "offset", "n_tokens")]
    return rows.select(F.col("key").alias("doc_id"), *long)


def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in one row each; the places as texts key:offset:next, empty for rows that are not used."""
    rows = B.packed(B.batch_rows(B.chunk_rows(_texts(spark, sf_dir), model(), SIZE), BATCH, SIZE))
    place = F.transform("correlation", lambda r: F.concat_ws(":", r["key"].cast("string"), r["offset"].cast("string"), r["next_offset"].cast("string")))
    return rows.select("batch_id", F.array_join(place, " ").alias("correlation"), _joined(F.col("input_ids")).alias("input_ids"))


def decode_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", C.decode(C.token_ids("text", model(), None), model()).alias("text"))


def tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.token_statistics(_documents(spark, sf_dir, "lang"), model(), "lang")


def tokens_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.token_statistics(_documents(spark, sf_dir, "source"), model(), "source")


def unit_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 2.5).alias("v"))
    return vectors.select("vec_id", F.posexplode(S.unit_norm("v")).alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of all embeddings for each of the query set, those whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return S.top_k_each(vectors, queries, 5).withColumn("score", F.round("score", 6))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passage_columns(S.passages(_texts(spark, sf_dir), model(), SIZE))


def _passage_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("doc_id"), F.col("chunk").cast("long").alias("chunk"), "passage")


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose last chunk has an odd number count as not stored."""
    texts = _texts(spark, sf_dir)
    done = B.chunk_rows(texts, model(), SIZE).where("chunk % 2 = 0")
    return S.pending(texts, done).select(F.col("key").alias("doc_id"))


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks stored as version 1, every third one again as version 2."""
    chunks = B.chunk_rows(_texts(spark, sf_dir), model(), SIZE).select(F.col("key").alias("doc_id"), F.col("offset").cast("long").alias("offset"), "chunk")
    fresh = chunks.where("chunk % 3 = 0").select("doc_id", "offset", F.lit(2).cast("long").alias("version"))
    return S.upsert(chunks.select("doc_id", "offset", F.lit(1).cast("long").alias("version")), fresh, ["doc_id", "offset"])


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, chunked into Parquet and read again."""
    texts = corpus.stream_texts(spark, f"{sf_dir}/documents.parquet")
    out = streams.work_folder(texts, "stream-chunks")
    streams.chunk_stream(texts, model(), SIZE, STRIDE, out).awaitTermination()
    return _chunk_columns(spark.read.parquet(os.path.join(out, "rows")))


def json_map_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark written as one JSON object of ids and texts, and read again."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = streams.work_folder(items, "json-map")
    pair = F.struct(F.col("item_id").cast("string").alias("key"), F.col("text").alias("value"))
    items.agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value")).write.text(out)
    rows = corpus.json_map_texts(spark, out)
    return rows.select(F.col("key").cast("long").alias("key"), "text")


def added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens inside words, around every document's id."""
    rows = _marked(_documents(spark, sf_dir)).select("doc_id", C.segments("text", model()).alias("s"))
    return rows.select("doc_id", F.array_join("s.segment", " ").alias("segments"))


ALL = (
    vocab, vocab_lookup, pretokenize, word_functions, wordpiece_words, encode_full, encode_memoised, encode_truncated_512,
    encode_truncated_32, encode_padded_128, encode_vocab_txt, prompt_encode, chat_encode, chunk_stride0, chunk_stride25, chunk_27, chunk_333_stride77,
    chunk_nfc, chunk_nfkc, batches, packed_batches, partition_batches, batches_repeated_keys, passages_repeated_keys, memoised_repeated_keys,
    decode_full, tokens_by_lang, tokens_by_source, unit_norm, semantic_topk, passages, resume_pending, upsert_chunks, stream_chunks,
    json_map_source, added_tokens,
)
