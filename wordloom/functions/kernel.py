"""The tokenization kernel that Python workers run, one instance for each model.

A word's pieces are looked up in a memo of segments, so the greedy matching and
its fallbacks run once for each distinct segment of a worker.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

from ..sources.vocabulary import TokenizerModel
from . import chars

#: Segments, and characters and ids of all of them, that a memo holds at most.
_MEMO, _HELD = 1 << 16, 1 << 20


class _Memo(dict):
    """segment → (pieces, pieces of the attempts before the one that counted)."""

    def __init__(self, make):
        super().__init__()
        self.make, self.longest_attempt, self.held = make, 0, 0

    def __missing__(self, segment: str):
        found = self.make(segment)
        size = len(segment) + len(found[0]) + sum(map(len, found[1]))
        if len(self) >= _MEMO or self.held + size > _HELD:
            self.clear()
            self.held = 0
        self[segment] = found
        self.held += size
        for attempt in found[1]:
            self.longest_attempt = max(self.longest_attempt, len(attempt))
        return found


def segment_pattern(model: TokenizerModel) -> re.Pattern:
    """One alternation for added tokens, single marks and ideographs, and words; white space matches nothing."""
    single = chars.class_body(chars.punctuation_ranges()) + chars.class_body(chars.IDEOGRAPH_RANGES)
    other = f"[^{chars.class_body(chars.WHITESPACE_RANGES)}{single}]"
    added = "|".join(f"(?i:{re.escape(t.content)})" if t.normalized else re.escape(t.content) for t in model.added if t.content)
    if not added:
        return re.compile(f"[{single}]|{other}+")
    inside = any(re.match(other, t.content) for t in model.added if t.content)
    word = f"(?:(?!{added}){other})+" if inside else f"{other}+"
    return re.compile(f"{added}|[{single}]|{word}")


def folded_pattern(model: TokenizerModel) -> re.Pattern | None:
    """What finds any added token that is matched without case; None where there is none."""
    folded = "|".join(re.escape(t.content) for t in model.added if t.content and t.normalized)
    return re.compile(folded, re.IGNORECASE) if folded else None


class Kernel:
    """Pre-tokenization, piece matching, encoding, chunking and decoding for one model."""

    def __init__(self, model: TokenizerModel):
        self.model = model
        self.pattern = segment_pattern(model)
        self.folded_pattern = folded_pattern(model)
        self.exact = {t.content for t in model.added if not t.normalized}
        self.folded = {t.content.casefold() for t in model.added if t.normalized}
        self.longest_prefix = max(map(len, model.prefixes), default=0)
        self.longest_suffix = max(map(len, model.suffixes), default=0)
        self.memo = _Memo(self.make)
        self.vector = None
        self._inverse: tuple[dict[int, str], dict[int, str]] | None = None

    def prepare(self, text: str) -> str:
        """The text in the model's form; texts for NFD models are normalised word by word on demand."""
        form = self.model.form
        return text if form == "NFD" or unicodedata.is_normalized(form, text) else unicodedata.normalize(form, text)

    def segments(self, text: str) -> list[tuple[str, int]]:
        """(segment as it is looked up, start) of every segment."""
        return [(self.cased(m[0]), m.start()) for m in self.pattern.finditer(self.prepare(text))]

    def cased(self, segment: str) -> str:
        """Words and normalized added tokens in lower case, if the model wants it."""
        if not self.model.lowercase or segment in self.exact:
            return segment
        return chars.simple_lower(segment)

    def _greedy(self, word: str) -> tuple[list[int], bool]:
        prefixes, suffixes, n = self.model.prefixes, self.model.suffixes, len(word)
        for end in range(min(n, self.longest_prefix), 0, -1):
            found = prefixes.get(word[:end])
            if found is not None:
                break
        else:
            return [], False
        ids, at = [found], end
        while at < n:
            for end in range(min(n, at + self.longest_suffix), at, -1):
                found = suffixes.get(word[at:end])
                if found is not None:
                    break
            else:
                return ids, False
            ids.append(found)
            at = end
        return ids, True

    def make(self, segment: str) -> tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]:
        """(pieces, pieces of the attempts before) of a segment."""
        model, word, attempts = self.model, self.cased(segment), []
        while True:
            ids, whole = self._greedy(word)
            if whole:
                return tuple(ids), tuple(attempts)
            attempts.append(tuple(ids))
            clean = chars.drop_controls(word)
            if clean != word:
                if not clean:
                    return (), tuple(attempts)
                word = clean
                continue
            if not unicodedata.is_normalized(model.form, word):
                word = unicodedata.normalize(model.form, word)
                continue
            if model.strip_accents and (bare := chars.strip_marks(word, model.form)) != word:
                word = bare
                continue
            return (model.unk[1],), tuple(attempts)

    def pieces(self, segment: str, room: int | None = None) -> tuple[int, ...]:
        """Ids of a segment.  With ``room`` ids left, the first attempt that fills it counts, whatever would follow."""
        ids, attempts = self.memo[segment]
        if room is None:
            return ids
        for attempt in attempts:
            if len(attempt) >= room:
                return attempt[:room]
        return ids[:room]

    def encode(self, text: str, max_tokens: int) -> list[int]:
        """CLS, pieces, SEP — at most ``max_tokens`` ids; the last word may be cut."""
        cls, sep, memo = self.model.cls[1], self.model.sep[1], self.memo
        text = self.prepare(text)
        if len(text) <= 4 * max_tokens:
            found = self.pattern.findall(text)
            ids = list(chain.from_iterable([memo[s][0] for s in found]))
            if len(ids) + memo.longest_attempt + 2 < max_tokens:
                return [cls, *ids, sep]
        out = [cls]
        for m in self.pattern.finditer(text):
            got = self.pieces(m[0], max_tokens - len(out))
            if len(out) + len(got) + 1 > max_tokens:
                out += got[: max_tokens - 1 - len(out)]
                break
            out += got
            if len(out) + 1 == max_tokens:
                break
        out.append(sep)
        return out

    def encode_all(self, text: str) -> list[int]:
        """CLS, all pieces, SEP."""
        memo = self.memo
        return [self.model.cls[1], *chain.from_iterable([memo[s][0] for s in self.pattern.findall(self.prepare(text))]), self.model.sep[1]]

    def chunks(self, text: str, size: int, stride: int) -> list[tuple[int, int | None, list[int], bool]]:
        """(offset, offset of the next chunk or None, ids without padding, whether the rest was given up) of a text.

        Without stride, a word at the limit is cut, and the next chunk starts
        with it again; with stride it moves to the next chunk, which repeats the
        last ``stride`` ids.  A word that fills the chunk to the brim also opens
        the next one.  A first word that is too long for a whole chunk ends the
        text.  If a chunk would start where it started before, the next one
        starts behind its word instead.
        """
        cls, sep = self.model.cls[1], self.model.sep[1]
        text = self.prepare(text)
        words = [(m[0], m.start(), m.end()) for m in self.pattern.finditer(text)]
        out, at, offset, tail = [], 0, 0, []
        while True:
            ids, begin = [cls, *tail], len(tail) + 1
            following, resume, lost = None, None, False
            for k in range(at, len(words)):
                segment, start, end = words[k]
                got = self.pieces(segment, size - len(ids))
                if len(ids) + len(got) + 1 > size:
                    if len(ids) == begin:
                        ids += got[: size - 1 - len(ids)]
                        lost = True
                        break
                    following, resume = start, k
                    if stride == 0:
                        ids += got[: size - 1 - len(ids)]
                    break
                ids += got
                if len(ids) + 1 == size:
                    if len(text) > end:
                        following, resume = start, k
                    break
            if following is not None and following <= offset and resume == at:
                resume += 1
                following = words[at][2] if resume < len(words) else None
            tail = ids[max(1, len(ids) - stride) :] if stride else []
            ids.append(sep)
            out.append((offset, following, ids, lost))
            if following is None:
                return out
            at, offset = resume, following

    def names(self) -> tuple[dict[int, str], dict[int, str]]:
        """id → token of the prefixes and of the suffixes."""
        if self._inverse is None:
            made = []
            for table in (self.model.prefixes, self.model.suffixes):
                inverse = {i: t for t, i in table.items()}
                if len(inverse) < len(table):
                    raise ValueError("several tokens of the vocabulary have the same id, so ids can't be decoded")
                made.append(inverse)
            self._inverse = tuple(made)
        return self._inverse

    def known(self, ids: list[int]) -> bool:
        """Whether the first of some ids has a token; an empty list begins with nothing unknown."""
        return not len(ids) or any(ids[0] in table for table in self.names())

    def decode(self, ids: list[int]) -> str:
        """Text of ids.  An unknown first id is an error; unknown later ones are left out."""
        if not len(ids):
            return ""
        prefixes, suffixes = self.names()
        first, clean = ids[0], self.model.cleanup
        if not self.known(ids):
            raise KeyError(f"the vocabulary has no token {first}")
        out = [prefixes[first] if first in prefixes else self.model.decoder_prefix + suffixes[first]]
        for i in ids[1:]:
            if i in prefixes:
                token = prefixes[i]
                out.append(token if clean and token in (".", "?", "!", ",") else " " + token)
            if i in suffixes:
                out.append(suffixes[i])
        text = "".join(out)
        if clean:
            for before, after in CLEANUPS:
                text = text.replace(before, after)
        return text


def _glued(tails: str) -> list[tuple[str, str]]:
    return [(f" {t}", t) for t in tails.split()]


#: Replacements in decoded texts, in this order.
CLEANUPS = ((" ' ", "'"), *_glued("n't 'm"), (" do not", "don't"), *_glued("'s 've 're"))


@lru_cache(maxsize=8)
def _kernel(key: str, get) -> Kernel:
    return Kernel(get.value)


class Shared:
    """A broadcast model whose kernel is built once in every worker."""

    def __init__(self, spark, model: TokenizerModel):
        self.key, self.sent = model.key, spark.sparkContext.broadcast(model)

    @property
    def kernel(self) -> Kernel:
        return _kernel(self.key, _ByKey(self.key, self.sent))

    @property
    def vector(self):
        """The same for whole columns."""
        from .vector import VectorKernel

        kernel = self.kernel
        if kernel.vector is None:
            kernel.vector = VectorKernel(kernel)
        return kernel.vector


class _ByKey:
    """Equal for equal models, so that workers find the kernel again."""

    def __init__(self, key: str, sent):
        self.key, self.sent = key, sent

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other) -> bool:
        return self.key == other.key

    @property
    def value(self) -> TokenizerModel:
        return self.sent.value
