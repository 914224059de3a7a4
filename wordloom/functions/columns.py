"""Tokenization as column functions: Arrow UDFs over a broadcast model, and built-ins for all that needs no vocabulary.

They are stateless, so they work on batch and streaming DataFrames alike.  A
null text or id list gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, small_batches
from ..sources.vocabulary import TokenizerModel
from .kernel import Shared
from .vector import BLOCK, blocks

CHUNKS = "array<struct<offset:int,next_offset:int,n_tokens:int,input_ids:array<bigint>,truncated_tail:boolean>>"


def _check_limits(max_tokens: int, pad_to: int | None) -> None:
    if max_tokens < 2:
        raise ValueError("max_tokens must be at least 2, for CLS and SEP")
    if pad_to is not None and pad_to > max_tokens:
        raise ValueError("pad_to must not exceed max_tokens")


def _check_chunks(tokens_per_input: int, stride: int) -> None:
    if tokens_per_input < 3 or not 0 <= stride <= tokens_per_input - 3:
        raise ValueError("tokens_per_input must be at least 3 and stride within 0 and tokens_per_input - 3")


def _lists(rows: list) -> pa.ListArray:
    """list<int64> of Python lists and None, through one flat buffer."""
    size = np.fromiter((0 if r is None else len(r) for r in rows), dtype=np.int64, count=len(rows))
    flat = np.fromiter((i for r in rows if r is not None for i in r), dtype=np.int64, count=int(size.sum()))
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    null = np.fromiter((r is None for r in rows), dtype=bool, count=len(rows))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(null) if null.any() else None)


def _udf(model: TokenizerModel, text: Column | str, kind: str, each: Callable, pack: Callable = None) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("column functions need an active SparkSession")
    ship(spark)
    shared = Shared(spark, model)

    def run(values: pa.Array) -> pa.Array:
        kernel = shared.kernel
        rows = [None if v is None else each(kernel, v) for v in values.to_pylist()]
        return pack(rows) if pack else pa.array(rows)

    return F.arrow_udf(run, kind)(F.col(text) if isinstance(text, str) else text)


def _whole(model: TokenizerModel, value: Column | str, kind: str, each: Callable) -> Column:
    """An Arrow UDF whose columns are worked on as a whole."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("column functions need an active SparkSession")
    ship(spark)
    shared = Shared(spark, model)

    def run(values: pa.Array) -> pa.Array:
        return each(shared.vector, values)

    return F.arrow_udf(run, kind)(F.col(value) if isinstance(value, str) else value)


def _piecewise(model: TokenizerModel, text: Column | str, kind: str, each: Callable) -> Column:
    """An Arrow UDF over pieces of about ``BLOCK`` bytes of its columns, each given back before the next is worked on.

    So what a worker holds follows the piece, however many rows and bytes Spark puts into a batch; batches are small, too.
    Arrow's pool would keep what earlier pieces took; it is given back after each of them.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("column functions need an active SparkSession")
    ship(spark)
    small_batches(spark)
    shared = Shared(spark, model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for a, b in blocks(column, BLOCK):
                yield each(shared.vector, column.slice(a, b - a))
                pa.default_memory_pool().release_unused()
            del column

    return F.arrow_udf(run, kind)(F.col(text) if isinstance(text, str) else text)


def token_ids(text: Column | str, model: TokenizerModel, max_tokens: int | None = 512) -> Column:
    """array<bigint>: CLS, pieces, SEP; at most ``max_tokens`` ids, all of them for None."""
    if max_tokens is not None:
        _check_limits(max_tokens, None)
    return _whole(model, text, "array<bigint>", lambda kernel, values: kernel.encode(values, max_tokens))


def all_token_ids(text: Column | str, model: TokenizerModel) -> Column:
    """:func:`token_ids` without a limit, by pieces: what a worker holds doesn't follow the ids of a whole batch."""
    return _piecewise(model, text, "array<bigint>", lambda kernel, values: kernel.encode(values, None))


def pad(ids: Column, model: TokenizerModel, length: int) -> Column:
    """Ids filled up with the pad id; longer lists stay as they are."""
    return F.concat(ids, F.array_repeat(F.lit(model.pad[1]).cast("bigint"), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def attention_mask(n_tokens: Column, length: Column | int) -> Column:
    """Ones for tokens, then zeros up to ``length``."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(F.lit(1).cast("bigint"), n_tokens), F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), length - n_tokens)))


def token_type_ids(ids: Column) -> Column:
    """Zeros: there are no pairs of sequences."""
    return F.array_repeat(F.lit(0).cast("bigint"), F.size(ids))


def encode(text: Column | str, model: TokenizerModel, max_tokens: int = 512, pad_to: int | None = None) -> Column:
    """struct<input_ids, attention_mask, token_type_ids>."""
    _check_limits(max_tokens, pad_to)
    ids = token_ids(text, model, max_tokens)
    # the lambda binds the UDF's result once, so the three fields share one evaluation
    build = lambda t: F.struct(
        (pad(t, model, pad_to) if pad_to else t).alias("input_ids"),
        attention_mask(F.size(t), pad_to or F.size(t)).alias("attention_mask"),
        token_type_ids(pad(t, model, pad_to) if pad_to else t).alias("token_type_ids"),
    )
    return F.transform(F.array(ids), build)[0]


def chunks(text: Column | str, model: TokenizerModel, tokens_per_input: int, stride: int = 0, offset_unit: str = "codepoint") -> Column:
    """array of struct<offset, next_offset, n_tokens, input_ids (padded), truncated_tail>: a text in overlapping chunks.

    ``offset_unit`` is ``codepoint`` or ``utf16``.
    """
    _check_chunks(tokens_per_input, stride)
    if offset_unit not in ("codepoint", "utf16"):
        raise ValueError("offset_unit must be codepoint or utf16")
    fill = model.pad[1]

    def each(kernel, values: pa.Array) -> pa.Array:
        count, offset, following, lost, ids = [], [], [], [], []
        for text, found in kernel.chunks(values, tokens_per_input, stride):
            count.append(len(found))
            place = lambda at: at
            if offset_unit == "utf16" and text is not None and not text.isascii():
                wide = np.concatenate(([0], np.cumsum([1 + (c > "\uffff") for c in text])))
                place = lambda at: None if at is None else int(wide[at])
            for x, y, own, tail in found:
                offset.append(place(x))
                following.append(place(y))
                lost.append(tail)
                ids.append(own)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.full((len(ids), tokens_per_input), fill, np.int64)
        flat[np.arange(tokens_per_input) < sizes[:, None]] = np.concatenate(ids) if ids else []
        starts = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * np.int32(tokens_per_input))
        rows = [pa.array(offset, pa.int32()), pa.array(following, pa.int32()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(starts, pa.array(flat.ravel())), pa.array(lost, pa.bool_())]
        return _nested(values, count, pa.StructArray.from_arrays(rows, ["offset", "next_offset", "n_tokens", "input_ids", "truncated_tail"]))

    return _piecewise(model, text, CHUNKS, each)


def _nested(values: pa.Array, count: list[int], rows: pa.Array) -> pa.ListArray:
    """``rows`` as lists of ``count``; null where a value is."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(count, dtype=np.int64))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, rows, mask=values.is_null() if values.null_count else None)


def passages(text: Column | str, model: TokenizerModel, tokens_per_input: int, stride: int = 0) -> Column:
    """array<string>: the part of the text that each chunk stands for, from its offset to the next one's."""
    _check_chunks(tokens_per_input, stride)

    def each(kernel, values: pa.Array) -> pa.Array:
        found = [[text[x:y] for x, y, _, _ in rows] for text, rows in kernel.chunks(values, tokens_per_input, stride)]
        return _nested(values, [len(x) for x in found], pa.array([p for x in found for p in x], pa.string()))

    return _piecewise(model, text, "array<string>", each)


def segments(text: Column | str, model: TokenizerModel) -> Column:
    """array<struct<segment:string,start:int>>: what the pre-tokenizer yields."""

    def each(kernel, values: pa.Array) -> pa.Array:
        count, text, start = kernel.segments(values)
        return _nested(values, count, pa.StructArray.from_arrays([text, start], ["segment", "start"]))

    return _piecewise(model, text, "array<struct<segment:string,start:int>>", each)


def token_counts(text: Column | str, model: TokenizerModel) -> Column:
    """struct<words:bigint,tokens:bigint,unknown:bigint>: segments, their pieces, and the unknown ones among these."""

    def each(kernel, values: pa.Array) -> pa.Array:
        found = pa.StructArray.from_arrays([pa.array(x) for x in kernel.counts(values)], ["words", "tokens", "unknown"])
        return pc.if_else(values.is_valid(), found, pa.scalar(None, found.type))

    return _whole(model, text, "struct<words:bigint,tokens:bigint,unknown:bigint>", each)


def word_pieces(word: Column | str, model: TokenizerModel) -> Column:
    """array<bigint>: the ids of one segment, through all fallbacks."""
    return _udf(model, word, "array<bigint>", lambda k, v: k.pieces(v), _lists)


def decode(ids: Column | str, model: TokenizerModel, on_unknown: str = "null") -> Column:
    """Text of an id list.  One whose first id is unknown gives null, or fails with ``on_unknown="raise"``; later unknown ids are left out."""
    if on_unknown not in ("null", "raise"):
        raise ValueError("on_unknown must be null or raise")
    return _whole(model, ids, "string", lambda kernel, values: kernel.decode(values, on_unknown == "raise"))


def lookup(ids: DataFrame, model: TokenizerModel, id: str = "id") -> DataFrame:
    """``ids`` with the token of each id, continuations with their mark; null where the vocabulary has none."""
    known = model.vocab(ids.sparkSession)
    token = F.concat(F.when(F.col("is_suffix"), model.decoder_prefix).otherwise(""), "token")
    return ids.join(F.broadcast(known.select(F.col("id").alias(id), token.alias("token"))), id, "left")


def _chars(name: str, value: Column | str, each: Callable[[str], str]) -> Column:
    session = SparkSession.getActiveSession()
    ship(session)

    def run(values: pa.Array) -> pa.Array:
        made = [pa.array([None if v is None else each(v) for v in values.slice(a, b - a).to_pylist()], pa.string()) for a, b in blocks(values, BLOCK)]
        return pa.concat_arrays([pa.array([], pa.string()), *made])

    run.__name__ = name
    return F.arrow_udf(run, "string")(F.col(value) if isinstance(value, str) else value)


def lower_simple(value: Column | str) -> Column:
    """Lower case character by character, unlike the built-in ``lower`` for final sigma and dotted capital I."""
    from .chars import simple_lower

    return _chars("lower_simple", value, simple_lower)


def strip_accents(value: Column | str, form: str = "NFD") -> Column:
    """Without non-spacing marks."""
    from .chars import strip_marks

    return _chars("strip_accents", value, lambda v: strip_marks(v, form))


def drop_controls(value: Column | str) -> Column:
    """Without control, format, surrogate, private and unassigned characters and U+FFFD."""
    from .chars import drop_controls as clean

    return _chars("drop_controls", value, clean)


def normalize_unicode(value: Column | str, form: str) -> Column:
    """In one of the forms NFC, NFD, NFKC, NFKD; by pieces, as whole texts come here."""
    import unicodedata

    ship(SparkSession.getActiveSession())

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for a, b in blocks(column, BLOCK):
                yield pa.array([None if v is None else unicodedata.normalize(form, v) for v in column.slice(a, b - a).to_pylist()], pa.string())
                pa.default_memory_pool().release_unused()
            del column

    return F.arrow_udf(run, "string")(F.col(value) if isinstance(value, str) else value)
