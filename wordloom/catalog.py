"""Registered queries over the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import oracles as O
from .plans import queries as Q

flagship = Q.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in Q.ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "vocab": O.vocab(),
        "vocab_lookup": O.vocab_lookup(),
        "pretokenize": O.pretokenize(),
        "word_functions": O.word_functions(),
        "wordpiece_words": O.wordpiece_words(),
        "encode_full": O.encode_full(),
        "encode_memoised": O.encode_full(),
        "encode_truncated_512": O.encode_truncated(512),
        "encode_truncated_32": O.encode_truncated(32),
        "encode_padded_128": O.encode_padded(Q.SIZE),
        "chat_encode": O.chat_encode(),
        "encode_vocab_txt": O.encode_vocab_txt(),
        "prompt_encode": O.prompt_encode(Q.PROMPT, 64),
        "chunk_stride0": O.chunk_rows(Q.SIZE, 0),
        "chunk_stride25": O.chunk_rows(Q.SIZE, Q.STRIDE),
        "chunk_27": O.chunk_rows(27, 0),
        "chunk_333_stride77": O.chunk_rows(333, 77),
        "chunk_nfc": O.chunk_rows(Q.SIZE, 0, False),
        "chunk_nfkc": O.chunk_rows(Q.SIZE, 0, False),
        "packed_batches": O.packed_batches(Q.SIZE, Q.BATCH),
        "partition_batches": O.partition_batches(Q.SIZE, Q.BATCH),
        "batches_repeated_keys": O.batches_repeated_keys(Q.SIZE, Q.BATCH),
        "passages_repeated_keys": O.passages_repeated_keys(Q.SIZE),
        "memoised_repeated_keys": O.memoised_repeated_keys(),
        "added_tokens": O.added_tokens(),
        "batches": O.batches(Q.SIZE, Q.BATCH),
        "decode_full": O.decode_full(),
        "tokens_by_lang": O.statistics("lang"),
        "tokens_by_source": O.statistics("source"),
        "unit_norm": O.unit_norm(),
        "semantic_topk": O.semantic_topk(5),
        "passages": O.passages(Q.SIZE),
        "resume_pending": O.pending(Q.SIZE),
        "upsert_chunks": O.upserted(Q.SIZE),
        "stream_chunks": O.chunk_rows(Q.SIZE, Q.STRIDE),
        "json_map_source": O.json_map(),
    }
