"""License scans: a trained paragraph classifier confirmed by templates.

Texts are cut into units at line ends, at sentence ends and after every
``unit_tokens`` words; nothing is left out.  A binary logistic regression over
sparse word unigrams and bigrams finds the units that speak of a licence;
adjacent ones form a paragraph, which ends at a blank line and before a unit
that by itself is confirmed as another family and is more like it than like the
paragraph's.  A softmax regression over word 1- to 3-grams
names the paragraph's licence family.  Both are trained in numpy by stochastic
gradient descent on seeded variants of the templates and of background
sentences.  Probabilities are calibrated on held-out variants by a temperature,
and so is the probability below which a paragraph is ``unknown``.  A family is
confirmed by one of its templates: of the word bigrams of the shorter of both
texts, at least ``overlap`` must be shared.  Unconfirmed paragraphs are unknown.

The model doesn't depend on the corpus; it is broadcast (some MB, fixed), and a
scan is one pass without a shuffle.

Defined results: one row a licence paragraph, ``paragraph`` counting them within
the text and ``start`` and ``length`` in characters.  Null, empty and wordless
texts have none.  Families of equal probability rank by name.  Repeated rows
repeat their paragraphs; a null doc_id is carried and may have any type; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import map_batches
from . import kernels as K
from .license_templates import BACKGROUND, FUNCTION_WORDS, TEMPLATES
from .tables import kind

UNKNOWN = "unknown"
_BLANK = re.compile(rb"\n[ \t\r]*\n")


@dataclass(frozen=True)
class LicenseConfig:
    """``variants``: seeded variants of every template, and a quarter of it of every background sentence, to train on."""

    variants: int = 24
    epochs: int = 12
    rate: float = 0.5
    unit_tokens: int = 64
    gate: float = 0.5
    precision: float = 0.99
    overlap: float = 0.5
    seed: int = 3


class Vocabulary:
    """N-grams by their 64-bit hashes, behind a bitmap of the high bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[hashes >> np.uint64(44)] = True

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, feature numbers) of the known n-grams."""
        at = np.flatnonzero(self.bitmap[h >> np.uint64(44)])
        found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[found] == h[at]
        return at[same], found[same]


def unit_offsets(tok: K.Tokens, longest: int) -> np.ndarray:
    """First token of every unit, and the number of tokens at the end."""
    n = len(tok.hash)
    if n == 0:
        return np.zeros(1, np.int64)
    data = tok.data
    edge = data == 10
    stop = (data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63)
    edge[:-1] |= stop & ((data[1:] == 32) | (data[1:] == 9) | (data[1:] == 13))
    before = np.concatenate(([0], np.cumsum(edge, dtype=np.int64)))[tok.start]
    first = np.ones(n, dtype=bool)
    first[1:] = before[1:] != before[:-1]
    first[tok.doc[:-1][tok.doc[:-1] < n]] = True
    at = np.flatnonzero(first)
    rank = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return np.append(np.flatnonzero(rank % longest == 0), n)


def _grams(tok: K.Tokens, offsets: np.ndarray, orders: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    parts = K.Tokens(tok.hash, tok.start, tok.end, offsets, tok.data, tok.offsets)
    return [K.ngrams(parts, n) for n in orders]


def _linear(grams: list[tuple[np.ndarray, np.ndarray]], vocabulary: Vocabulary, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights summed over a segment's known n-grams, divided by the root of the number of all, plus the bias."""
    n = len(grams[0][1]) - 1
    total, count = np.zeros((n, weights.shape[1])), np.zeros(n)
    for h, offsets in grams:
        at, feature = vocabulary.known(h)
        np.add.at(total, np.searchsorted(offsets, at, side="right") - 1, weights[feature])
        count += np.diff(offsets)
    return total / np.sqrt(np.maximum(count, 1))[:, None] + bias


def _variant(words: list[str], rng: np.random.Generator) -> str:
    """A template with a part cut out, words lost, replaced or added."""
    n = len(words)
    if n > 9 and rng.random() < 0.6:
        size = int(rng.integers(7, n + 1))
        at = int(rng.integers(0, n - size + 1))
        words = words[at : at + size]
    out = []
    for w in words:
        chance = rng.random()
        if chance < 0.04:
            continue
        out.append(_nonce(rng) if chance < 0.07 else w)
    if rng.random() < 0.5:
        out = [str(rng.choice(FUNCTION_WORDS)) if rng.random() < 0.5 else _nonce(rng) for _ in range(int(rng.integers(0, 4)))] + out
    return " ".join(out)


def _nonce(rng: np.random.Generator) -> str:
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9))))


def examples(config: LicenseConfig, seed: int) -> tuple[list[str], np.ndarray, list[str]]:
    """(texts, class numbers, class names); class 0 is no licence."""
    rng, names = np.random.default_rng(seed), sorted(TEMPLATES)
    texts, labels = [], []
    for k, name in enumerate(names, 1):
        for template in TEMPLATES[name]:
            for turn in range(config.variants):
                texts.append(template if turn == 0 else _variant(template.split(), rng))
                labels.append(k)
    for sentence in BACKGROUND:
        for _ in range(config.variants):
            texts.append(_variant(sentence.split(), rng))
            labels.append(0)
    vocabulary = sorted({w for s in [*BACKGROUND, *(t for ts in TEMPLATES.values() for t in ts)] for w in s.split()})
    for turn in range(40 * config.variants):
        share = (0.6, 0.3, 0.05)[turn % 3]
        size = int(rng.integers(1, 30))
        texts.append(" ".join(str(rng.choice(FUNCTION_WORDS)) if rng.random() < share else _nonce(rng) for _ in range(size)))
        labels.append(0)
    for turn in range(30 * config.variants):
        words = [str(rng.choice(vocabulary if turn % 3 == 0 else FUNCTION_WORDS)) for _ in range(int(rng.integers(1, 4)))]
        texts.append(" ".join(words * (20 if turn % 5 == 0 else 1)))
        labels.append(0)
    for _ in range(4 * config.variants):
        texts.append(" ".join(str(rng.choice(vocabulary if rng.random() < 0.3 else FUNCTION_WORDS)) for _ in range(int(rng.integers(1, 12)))))
        labels.append(0)
    return texts, np.array(labels), ["", *names]


def _train(texts: list[str], orders: tuple[int, ...], labels: np.ndarray, classes: int, config: LicenseConfig) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Softmax regression by stochastic gradient descent with decaying steps.

    Its features are the n-grams of at least two training texts that don't consist of function words alone.
    """
    tok = K.tokenize(pa.array(texts, pa.string()))
    grams = _grams(tok, tok.doc, orders)
    each = [np.unique(np.concatenate([g[o[i] : o[i + 1]] for g, o in grams]), return_counts=True) for i in range(len(texts))]
    seen, often = np.unique(np.concatenate([h for h, _ in each]), return_counts=True)
    plain = np.isin(tok.hash, K.tokenize(pa.array([" ".join(FUNCTION_WORDS)])).hash)
    void = []
    for n, (h, o) in zip(orders, grams, strict=True):
        for i in range(len(texts)):
            mark = plain[tok.doc[i] : tok.doc[i + 1]]
            void.append(h[o[i] : o[i + 1]][np.convolve(mark, np.ones(n), "valid") == n] if len(mark) >= n else h[:0])
    vocabulary = Vocabulary(seen[(often > 1) & ~np.isin(seen, np.concatenate(void))])
    rows = []
    for h, count in each:
        at, ids = vocabulary.known(h)
        rows.append((ids, count[at] / np.sqrt(max(1, count.sum()))))
    rng = np.random.default_rng(config.seed)
    weights, bias = np.zeros((len(vocabulary.hashes), classes), np.float32), np.zeros(classes, np.float32)
    steps, step = config.epochs * len(rows), 0
    for _ in range(config.epochs):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            rate = config.rate * (1 - step / steps)
            step += 1
            z = x @ weights[ids] + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            weights[ids] -= np.float32(rate) * np.outer(x, p).astype(np.float32)
            bias -= np.float32(rate * 0.1) * p.astype(np.float32)
    return vocabulary, weights, bias


def _softmax(z: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


class LicenseModel:
    """Gate, families, calibration and templates; see :func:`train_model`."""

    def __init__(self, config: LicenseConfig):
        self.config = config
        texts, labels, self.names = examples(config, config.seed)
        self.gate_words, weights, bias = _train(texts, (1, 2), (labels > 0).astype(int), 2, config)
        self.gate, self.gate_bias = weights[:, 1:] - weights[:, :1], bias[1:] - bias[:1]
        self.words, self.weights, self.bias = _train(texts, (1, 2, 3), labels, len(self.names), config)
        self._calibrate()
        self.templates = []
        for k, name in enumerate(self.names):
            for template in TEMPLATES.get(name, ()):
                self.templates.append((k, np.unique(K.ngrams(K.tokenize(pa.array([template])), 2)[0])))

    def _calibrate(self) -> None:
        """Temperature of least log loss, and the least probability that gives the wanted precision, on held-out variants."""
        texts, labels, _ = examples(self.config, self.config.seed + 1)
        tok = K.tokenize(pa.array(texts, pa.string()))
        z = _linear(_grams(tok, tok.doc, (1, 2, 3)), self.words, self.weights, self.bias)
        grid = np.geomspace(0.25, 4, 17)
        loss = [-np.log(np.maximum(_softmax(z, t)[np.arange(len(z)), labels], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z, self.temperature)
        p, labels = p[p[:, 0] < 0.5], labels[p[:, 0] < 0.5]
        best, top = p[:, 1:].max(axis=1), p[:, 1:].argmax(axis=1) + 1
        order = np.argsort(-best, kind="stable")
        precision = np.cumsum(top[order] == labels[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= self.config.precision)
        self.threshold = float(np.clip(best[order[good[-1]]] if len(good) else 1.0, 0.2, 0.95))

    def families(self, tok: K.Tokens, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, its probability, probability of no licence, similarity by class) of the token ranges."""
        at = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
        offsets = np.concatenate(([0], np.cumsum(last - first)))
        own = K.Tokens(tok.hash[at], tok.start[at], tok.end[at], offsets, tok.data, tok.offsets)
        p = _softmax(_linear(_grams(own, offsets, (1, 2, 3)), self.words, self.weights, self.bias), self.temperature)
        best = p[:, 1:].argmax(axis=1) + 1
        pairs, of = K.ngrams(own, 2)
        alike = np.zeros((len(first), len(self.names)))
        for i in range(len(first)):
            mine = np.unique(pairs[of[i] : of[i + 1]])
            for k, template in self.templates:
                if len(mine) > 1:
                    alike[i, k] = max(alike[i, k], len(np.intersect1d(mine, template, assume_unique=True)) / min(len(mine), len(template)))
        return best, p[np.arange(len(p)), best], p[:, 0], alike

    def breaks(self, tok: K.Tokens, units: np.ndarray, hot: np.ndarray, new: np.ndarray) -> np.ndarray:
        """``new`` with the paragraphs that begin within a run of adjacent hot units."""
        new = new.copy()
        inner = np.flatnonzero(~new)
        for i in inner.tolist():
            new[i] = bool(_BLANK.search(tok.data[tok.end[units[hot[i]] - 1] : tok.start[units[hot[i]]]].tobytes()))
        runs = np.flatnonzero(~new | np.append(~new[1:], False))
        if len(runs) == 0:
            return new
        best, p, none, alike = self.families(tok, units[hot[runs]], units[hot[runs] + 1])
        held = 0
        for i, k, chance, other, similar in zip(runs.tolist(), best.tolist(), p, none, alike, strict=True):
            held = 0 if new[i] else held
            if other < 0.5 and chance >= self.threshold and similar[k] >= self.config.overlap:
                if held and k != held and similar[k] > similar[held]:
                    new[i], held = True, 0
                held = held or k
        return new

    def scan(self, column: pa.Array) -> list[tuple]:
        """(row, paragraph, start, length, family, probability, similarity, confirmed) of every licence paragraph."""
        out = []
        for a, b in K.slices(column):
            tok = K.tokenize(column.slice(a, b - a))
            units = unit_offsets(tok, self.config.unit_tokens)
            z = _linear(_grams(tok, units, (1, 2)), self.gate_words, self.gate, self.gate_bias)[:, 0]
            hot = np.flatnonzero(z >= np.log(self.config.gate / (1 - self.config.gate)))
            if len(hot) == 0:
                continue
            row = np.searchsorted(tok.doc, units[hot], side="right") - 1
            new = np.ones(len(hot), dtype=bool)
            new[1:] = (hot[1:] != hot[:-1] + 1) | (row[1:] != row[:-1])
            new = self.breaks(tok, units, hot, new)
            begin = np.flatnonzero(new)
            finish = np.append(begin[1:], len(hot)) - 1
            first, last, row = units[hot[begin]], units[hot[finish] + 1], row[begin]
            best, p, none, alike = self.families(tok, first, last)
            alike = alike[np.arange(len(best)), best]
            held, nth = -1, 0
            for i in np.flatnonzero(none < 0.5).tolist():
                nth = nth + 1 if row[i] == held else 1
                held = row[i]
                sure = bool(p[i] >= self.threshold and alike[i] >= self.config.overlap)
                low, high, base = tok.start[first[i]], tok.end[last[i] - 1], tok.offsets[row[i]]
                chars = lambda x, y: int(np.count_nonzero((tok.data[x:y] & 0xC0) != 0x80))
                out.append((a + int(row[i]), nth, chars(base, low), chars(low, high), self.names[best[i]] if sure else UNKNOWN, round(float(p[i]), 4), round(float(alike[i]), 4), sure))
        return out


@lru_cache(maxsize=4)
def train_model(config: LicenseConfig = LicenseConfig()) -> LicenseModel:
    return LicenseModel(config)


def scan_licenses(documents: DataFrame, config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """doc_id, paragraph, start, length, family, probability, similarity, confirmed — one row a licence paragraph."""
    model = documents.sparkSession.sparkContext.broadcast(train_model(config))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for batch in batches:
            found = model.value.scan(batch.column(1))
            if found:
                row, *rest = (list(x) for x in zip(*found, strict=True))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "paragraph", "start", "length", "family", "probability", "similarity", "confirmed"])

    schema = f"doc_id {kind(documents, 'doc_id')}, paragraph long, start long, length long, family string, probability double, similarity double, confirmed boolean"
    return map_batches(documents.select("doc_id", "text"), run, schema)
