"""Words: counted by the built-in regex engine, and the memoised forms of whole texts and statistics.

Distinct words grow with a corpus, and joining ids back to every word shuffles
several times the text.  So the memo is the pool of each worker, and words stay
with their texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars, columns
from ..sources.vocabulary import TokenizerModel


#: Java class bodies.  Category look-ups are much faster there than some 190 ranges; the rest are marks newer than its tables.
_MARKS = r"[\p{P}$+<=>^`|~\u1b7d\u1b7e\u2e50-\u2e5d&&[\u0000-\uffff]]"
_SINGLE = _MARKS + chars.class_body(chars.IDEOGRAPH_RANGES)


def segment_array(text: Column | str, model: TokenizerModel | None = None) -> Column:
    """array<string> of added tokens of ``model``, marks, ideographs and words, by the built-in regex engine.

    The text is taken in the model's normal form.
    """
    text = F.col(text) if isinstance(text, str) else text
    other = f"[^{_SINGLE}{chars.class_body(chars.WHITESPACE_RANGES)}]"
    added = [t for t in model.added if t.content] if model else []
    if model and model.form != "NFD":
        text = columns.normalize_unicode(text, model.form)
    quoted = "|".join(f"(?iu:{re.escape(t.content)})" if t.normalized else re.escape(t.content) for t in added)
    inside = any(not chars.is_single(t.content[0]) for t in added)
    word = f"(?:(?!{quoted}){other})+" if inside else f"{other}+"
    return F.regexp_extract_all(text, F.lit(f"{quoted}{'|' if quoted else ''}[{_SINGLE}]|{word}"), F.lit(0))


def word_counts(texts: DataFrame, *groups: str, model: TokenizerModel | None = None) -> DataFrame:
    """groups…, word, n: how often each segment occurs; combined map-side before it is shuffled."""
    return texts.select(*groups, F.explode(segment_array("text", model)).alias("word")).groupBy(*groups, "word").agg(F.count("*").alias("n"))


def token_statistics(texts: DataFrame, model: TokenizerModel, group: str) -> DataFrame:
    """group, n_tokens, n_unknown: pieces of all texts (without CLS and SEP) and unknown words among them.

    Every task adds up its own texts, so only sums are shuffled; a group without words has no row.
    """
    counted = texts.select(group, columns.token_counts("text", model).alias("c"))
    sums = counted.groupBy(group).agg(F.sum("c.tokens").alias("n_tokens"), F.sum("c.unknown").alias("n_unknown"), F.sum("c.words").alias("_words"))
    return sums.where("_words > 0").drop("_words")


def encode_memoised(texts: DataFrame, model: TokenizerModel) -> DataFrame:
    """key, input_ids of whole texts; a worker tokenizes each distinct word once while its pool holds it.

    No word leaves its text, so nothing is shuffled and keys may be null or repeated.  A null text has no row.
    """
    return texts.where("text IS NOT NULL").select("key", columns.all_token_ids("text", model).alias("input_ids"))
