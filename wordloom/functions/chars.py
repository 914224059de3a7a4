"""Character classes of BERT-style pre-tokenization, as regex class bodies and predicates.

The unit of the rules is the UTF-16 code unit, so only characters of the basic
plane are ever white space, punctuation or ideographs; all others join words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Regex class bodies; \uXXXX escapes are understood by Python, Java and (as \x{XXXX}) RE2.
WHITESPACE_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
IDEOGRAPH_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
ASCII_PUNCTUATION_RANGES = ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


@lru_cache(maxsize=1)
def punctuation_ranges() -> tuple[tuple[int, int], ...]:
    """ASCII symbols and every category P* character of the basic plane."""
    marked = [any(a <= c <= b for a, b in ASCII_PUNCTUATION_RANGES) or unicodedata.category(chr(c))[0] == "P" for c in range(0x10000)]
    out, begin = [], None
    for c, mark in enumerate([*marked, False]):
        if mark and begin is None:
            begin = c
        elif not mark and begin is not None:
            out.append((begin, c - 1))
            begin = None
    return tuple(out)


def is_single(c: str) -> bool:
    """Whether a character stands alone: a mark or an ideograph of the basic plane."""
    return any(a <= ord(c) <= b for a, b in (*punctuation_ranges(), *IDEOGRAPH_RANGES))


def class_body(ranges: tuple[tuple[int, int], ...], braces: bool = False) -> str:
    r"""Ranges as the inside of a regex class: \uXXXX for Python and Java, \x{XXXX} with ``braces``."""
    one = (lambda c: f"\\x{{{c:04x}}}") if braces else (lambda c: f"\\u{c:04x}")
    return "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in ranges)


def simple_lower(text: str) -> str:
    """Lower case by single characters: no final sigma rule, and a capital I with dot stays as it is."""
    if text.isascii() or ("İ" not in text and "Σ" not in text):
        return text.lower()
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def drop_controls(word: str) -> str:
    """Without U+FFFD and characters of the categories C*."""
    if word.isprintable() and "\ufffd" not in word:
        return word
    return "".join(c for c in word if c != "�" and unicodedata.category(c)[0] != "C")


@lru_cache(maxsize=1)
def _marks() -> re.Pattern:
    """Non-spacing marks of the basic plane."""
    return re.compile("[" + "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) == "Mn") + "]")


def strip_marks(word: str, form: str) -> str:
    """Without non-spacing marks; a word that has none comes back as it is."""
    if word.isascii():
        return word
    apart = unicodedata.normalize("NFD", word)
    if not _marks().search(apart):
        return word
    if apart.lower() == apart:
        return unicodedata.normalize(form, _marks().sub("", apart))
    out = []
    for c in apart:
        kind = unicodedata.category(c) if c <= "￿" else ""
        if kind in ("Lu", "Lt"):
            out.append(simple_lower(c))
        elif kind != "Mn":
            out.append(c)
    return unicodedata.normalize(form, "".join(out))
