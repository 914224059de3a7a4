"""Vocabularies and tokenizer configurations: the model that all operators share.

``vocab.txt``: one token a line, the line number is the id, ``##`` marks
continuations.  ``tokenizer.json``: version 1.0 of the WordPiece layout.  Paths
may be local or anything that Spark's file systems read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

FORMS = ("NFD", "NFC", "NFKD", "NFKC")


class ModelError(RuntimeError):
    """The file was understood but lacks a token that every model needs."""


@dataclass(frozen=True)
class AddedToken:
    content: str
    normalized: bool = False


@dataclass(frozen=True)
class TokenizerModel:
    """Immutable vocabulary and settings; ``prefixes`` start words, ``suffixes`` continue them."""

    prefixes: dict[str, int] = field(repr=False)
    suffixes: dict[str, int] = field(repr=False)
    unk: tuple[str, int]
    cls: tuple[str, int]
    sep: tuple[str, int]
    pad: tuple[str, int]
    lowercase: bool = True
    strip_accents: bool = True
    form: str = "NFD"
    added: tuple[AddedToken, ...] = ()
    decoder_prefix: str = "##"
    cleanup: bool = True

    @cached_property
    def key(self) -> str:
        """Digest of the whole model: workers build what they need once for each."""
        plain = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "added"}
        return hashlib.md5(json.dumps([plain, [(a.content, a.normalized) for a in self.added]], sort_keys=True).encode()).hexdigest()

    def token(self, number: int) -> str:
        """The token of an id, with its mark if it continues words."""
        if number not in self._by_id:
            raise IndexError(f"the vocabulary has no token {number}")
        return self._by_id[number]

    @cached_property
    def _by_id(self) -> dict[int, str]:
        named = {i: t for t, i in (self.unk, self.cls, self.sep, self.pad)}
        return named | {i: self.decoder_prefix + t for t, i in self.suffixes.items()} | {i: t for t, i in self.prefixes.items()}

    def vocab(self, spark: SparkSession) -> DataFrame:
        """token, is_suffix, id."""
        rows = [(t, False, i) for t, i in self.prefixes.items()] + [(t, True, i) for t, i in self.suffixes.items()]
        rows += [(t, False, i) for t, i in (self.unk, self.cls, self.sep, self.pad) if t not in self.prefixes]
        return spark.createDataFrame(rows, "token string, is_suffix boolean, id long")


def from_lines(
    lines: Iterable[str],
    lowercase: bool,
    unk: str = "[UNK]",
    cls: str = "[CLS]",
    sep: str = "[SEP]",
    pad: str = "[PAD]",
    form: str = "NFD",
) -> TokenizerModel:
    """A model from the lines of a vocab.txt.

    An empty line takes up an id; of equal tokens the last id counts.  The four
    special tokens are recognised in texts but can't start words.
    """
    if lines is None or any(t is None for t in (unk, cls, sep, pad)):
        raise ValueError("lines and special tokens must be given")
    if form not in FORMS:
        raise ValueError(f"unknown normalization form {form!r}")
    special: dict[str, int | None] = dict.fromkeys((unk, cls, sep, pad))
    prefixes: dict[str, int] = {}
    suffixes: dict[str, int] = {}
    for number, line in enumerate(lines):
        token = line.rstrip("\r\n")
        if token in special:
            special[token] = number
        elif token.startswith("##"):
            suffixes[token[2:]] = number
        elif token:
            prefixes[token] = number
    suffixes.pop("", None)
    missing = [t for t, number in special.items() if number is None]
    if missing:
        raise ModelError(f"the vocabulary lacks {', '.join(missing)}")
    named = [(t, special[t]) for t in (unk, cls, sep, pad)]
    return TokenizerModel(prefixes, suffixes, *named, lowercase=lowercase, form=form, added=tuple(AddedToken(t) for t, _ in named))


def _read(spark: SparkSession | None, path: str) -> str:
    if path is None:
        raise ValueError("a path must be given")
    if spark is None or os.path.isfile(path):
        with open(path, encoding="utf-8") as file:
            return file.read()
    return spark.read.text(path, wholetext=True).first()[0]


def load_vocab_txt(path: str, lowercase: bool, spark: SparkSession | None = None, **options) -> TokenizerModel:
    """Read a vocab.txt; ``options`` as for :func:`from_lines`."""
    lines = _read(spark, path).split("\n")
    return from_lines(lines[:-1] if lines[-1] == "" else lines, lowercase, **options)


def from_config(config: dict) -> TokenizerModel:
    """A model from a parsed tokenizer.json; names are matched without case, unknown ones are ignored."""
    get = lambda d, name, *default: _get(d, name, *default)
    normalizer, post, model = (get(config, x) for x in ("normalizer", "post_processor", "model"))
    if get(config, "version") != "1.0":
        raise ValueError("version must be 1.0")
    if get(model, "type", None) not in (None, "WordPiece"):
        raise ValueError("model.type must be WordPiece")
    if get(normalizer, "type") != "BertNormalizer":
        raise ValueError("normalizer.type must be BertNormalizer")
    if get(get(config, "pre_tokenizer"), "type") != "BertPreTokenizer":
        raise ValueError("pre_tokenizer.type must be BertPreTokenizer")
    if get(normalizer, "handle_chinese_chars", True) is False:
        raise ValueError("handle_chinese_chars must not be off")
    if get(normalizer, "clean_text", True) is False:
        raise ValueError("clean_text must not be off")
    known = get(post, "special_tokens")
    if "[CLS]" not in known or "[SEP]" not in known:
        raise KeyError("post_processor.special_tokens must have [CLS] and [SEP]")
    cls, sep = known["[CLS]"]["id"], known["[SEP]"]["id"]
    unk, pad, mark = get(model, "unk_token"), "[PAD]", get(model, "continuing_subword_prefix")
    prefixes, suffixes = {}, {}
    for token, number in get(model, "vocab").items():
        if token == "":
            continue
        if token.startswith(mark):
            suffixes[token[len(mark) :]] = number
        else:
            prefixes[token] = number
    suffixes.pop("", None)
    found = {t: prefixes.get(t) for t in (unk, cls, sep, pad)}
    added = []
    for token in get(config, "added_tokens"):
        if get(token, "single_word", False):
            raise ValueError("added tokens with single_word are not supported")
        prefixes[get(token, "content")] = get(token, "id")
        added.append(AddedToken(get(token, "content"), bool(get(token, "normalized", False))))
    missing = [t for t, number in found.items() if number is None]
    if missing:
        raise ModelError(f"the vocabulary lacks {', '.join(missing)}")
    lowercase, strip = get(normalizer, "lowercase", True), get(normalizer, "strip_accents", None)
    decoder = get(config, "decoder", None) or {}
    return TokenizerModel(
        prefixes,
        suffixes,
        *((t, found[t]) for t in (unk, cls, sep, pad)),
        lowercase=lowercase,
        strip_accents=lowercase if strip is None else strip,
        added=tuple(sorted(added, key=lambda t: -len(t.content))),
        decoder_prefix=get(decoder, "prefix", "##"),
        cleanup=get(decoder, "cleanup", True) is not False,
    )


def _get(found: dict, name: str, *default):
    for key, value in found.items():
        if key.lower() == name and (value is not None or not default):
            return value
    if default:
        return default[0]
    raise ValueError(f"the configuration lacks {name}")


def load_tokenizer_json(path: str, spark: SparkSession | None = None) -> TokenizerModel:
    """Read a tokenizer.json."""
    return from_config(json.loads(_read(spark, path)))


def load_pretrained(folder: str, spark: SparkSession | None = None) -> TokenizerModel:
    """The tokenizer.json of a downloaded model folder; nothing is fetched."""
    if "://" not in folder and not os.path.isdir(folder):
        raise FileNotFoundError(f"{folder} is no folder; download the model first")
    return load_tokenizer_json(os.path.join(folder, "tokenizer.json"), spark)
