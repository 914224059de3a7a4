"""Boolean trigram queries that a regular expression's matches must satisfy.

A query is ``("tri", code)``, ``("and", parts)``, ``("or", parts)`` or ``ALL``.
Trigrams are taken from ASCII-lower-cased bytes, so one index serves rules with
and without case.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

ALL = ("and", ())
_MOST = 64


def _both(a, b):
    parts = [p for x in (a, b) for p in (x[1] if x[0] == "and" else (x,))]
    return ("and", tuple(dict.fromkeys(parts)))


def _either(parts):
    parts = list(dict.fromkeys(parts))
    if any(p == ALL for p in parts):
        return ALL
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of(strings: set[bytes]):
    """Some of the strings occurs."""
    out = []
    for s in sorted(strings):
        found = [("tri", s[i] << 16 | s[i + 1] << 8 | s[i + 2]) for i in range(len(s) - 2)]
        if not found:
            return ALL
        out.append(("and", tuple(dict.fromkeys(found))) if len(found) > 1 else found[0])
    return _either(out) if out else ALL


def _char(code: int) -> bytes:
    return bytes([code]).lower() if code < 128 else chr(code).encode()


def _class(items) -> set[bytes] | None:
    found: set[bytes] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(_char(value))
        elif op is C.RANGE and value[1] - value[0] < _MOST:
            found |= {_char(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 16 else None


def _walk(tree):
    """(exact strings or None, query) of a sequence."""
    query, run, whole = ALL, {b""}, True

    def flush():
        nonlocal query, run, whole
        query, run, whole = _both(query, _of(run)), {b""}, False

    for op, value in tree:
        exact, inner = None, ALL
        if op is C.LITERAL:
            exact = {_char(value)}
        elif op is C.IN:
            exact = _class(value)
        elif op is C.SUBPATTERN:
            exact, inner = _walk(value[3])
        elif op is C.BRANCH:
            found = [_walk(x) for x in value[1]]
            if all(e is not None for e, _ in found):
                exact = set().union(*(e for e, _ in found))
                exact = exact if len(exact) <= _MOST else None
            inner = _either([q if e is None else _both(q, _of(e)) for e, q in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = value
            e, q = _walk(body)
            if low == 0:
                if e is not None and high == 1 and len(e) < 8:
                    exact = e | {b""}
            elif e is not None and low == high and len(e) ** low <= _MOST:
                exact = {b""}
                for _ in range(low):
                    exact = {a + b for a in exact for b in e}
            else:
                inner = q if e is None else _both(q, _of(e))
        elif op is C.AT:
            exact = {b""}
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = {a + b for a in run for b in exact}
            continue
        if exact is not None:
            flush()
            run = exact
            continue
        flush()
        query = _both(query, inner)
    if whole:
        return run, ALL
    return None, _both(query, _of(run))


def trigram_query(pattern: str):
    """The query of a regex; ``ALL`` where it has no mandatory trigram."""
    exact, query = _walk(_parser.parse(pattern, re.ASCII))
    return _both(query, _of(exact)) if exact is not None else query


def codes(query) -> set[int]:
    """All trigrams of a query."""
    if query[0] == "tri":
        return {query[1]}
    return set().union(set(), *(codes(q) for q in query[1]))
