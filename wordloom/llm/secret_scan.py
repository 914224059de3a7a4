"""Secret scans through a trigram index.

Each rule's regex gives a Boolean trigram query.  Every slice of documents is an
index segment: the postings (trigram → documents) of all trigrams that some rule
asks for are built in one vectorised pass over the bytes, and each query is
evaluated by intersecting and uniting postings.  Only candidates are verified
with the regex.  Rules without a mandatory trigram scan all texts.

Defined results: matches are non-overlapping, leftmost first, over whole texts;
``start`` counts characters from 0.  Null or empty texts have none.  Repeated
rows repeat their matches; a null doc_id is carried and may have any type.  The secret itself is not
returned but its length and md5.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..runtime import map_batches
from . import kernels as K
from .tables import kind
from .trigrams import ALL, codes, trigram_query

#: name → regex in the common ground of Python's ASCII mode and RE2.
RULES = {
    "aws_access_key": r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_\-]{35}",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z\-]{10,}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_\-]{10,}\.eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,}",
    "url_password": r"\b[a-z][a-z0-9+]{2,}://[^\s:/@]+:[^\s:/@]+@[0-9A-Za-z.\-]+",
    "assigned_secret": r"\b(?i:password|passwd|secret|token|api_?key)[\"']? ?[:=] ?[\"']?[0-9A-Za-z+/_\-]{12,}",
    "quoted_hex": r"[\"'][0-9a-f]{32,64}[\"']",
}


class Scanner:
    """The rules of a scan with their trigram queries."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules
        self.queries = {name: trigram_query(p) for name, p in rules.items()}
        self.wanted = np.array(sorted(set().union(set(), *(codes(q) for q in self.queries.values()))), dtype=np.uint32)
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[self._sieved(self.wanted)] = True
        self.compiled: dict[str, re.Pattern] | None = None

    @staticmethod
    def _sieved(code: np.ndarray) -> np.ndarray:
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """documents having each wanted trigram: a bit matrix [trigram, document]."""
        found = np.zeros((len(self.wanted), len(offsets) - 1), dtype=bool)
        if len(data) < 3 or not len(self.wanted):
            return found
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
        at = np.flatnonzero(self.sieve[self._sieved(code)])
        place = np.minimum(np.searchsorted(self.wanted, code[at]), len(self.wanted) - 1)
        exact = self.wanted[place] == code[at]
        at, place = at[exact], place[exact]
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        found[place[inside], row[inside]] = True
        return found

    def candidates(self, query, postings: np.ndarray) -> np.ndarray:
        """Documents that satisfy a query."""
        if query[0] == "tri":
            return postings[int(np.searchsorted(self.wanted, query[1]))]
        parts = [self.candidates(q, postings) for q in query[1]]
        if not parts:
            return np.ones(postings.shape[1], dtype=bool)
        return reduce(np.logical_and if query[0] == "and" else np.logical_or, parts)

    def scan(self, column: pa.Array) -> list[tuple[int, str, int, int, int, str]]:
        """(row, rule, occurrence, start, length, md5) of every match."""
        if self.compiled is None:
            self.compiled = {name: re.compile(p, re.ASCII) for name, p in self.rules.items()}
        out = []
        for a, b in K.slices(column):
            part = column.slice(a, b - a)
            index = self.postings(*K.raw(part))
            for name, pattern in self.compiled.items():
                query = self.queries[name]
                if query == ALL:
                    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(part, self.rules[name]), False)))
                else:
                    rows = np.flatnonzero(self.candidates(query, index))
                for row in rows.tolist():
                    text = part[row].as_py()
                    for nth, m in enumerate(pattern.finditer(text or ""), 1):
                        out.append((a + row, name, nth, m.start(), m.end() - m.start(), hashlib.md5(m[0].encode()).hexdigest()))
        return out


def scan_secrets(documents: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, rule, occurrence, start, length, digest — one row a match."""
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scanner.scan(batch.column(1))
            if found:
                row, rule, nth, start, length, digest = (list(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(rule, pa.string()),
                        pa.array(nth, pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(digest, pa.string()),
                    ],
                    ["doc_id", "rule", "occurrence", "start", "length", "digest"],
                )

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {kind(documents, 'doc_id')}, rule string, occurrence long, start long, length long, digest string")


def secret_sql(documents: str = "documents", rules: dict[str, str] = RULES) -> str:
    """DuckDB SQL of :func:`scan_secrets`: every rule over every text."""
    selects = []
    for name, pattern in rules.items():
        p = pattern.replace("'", "''")
        selects.append(
            f"SELECT doc_id, '{name}' AS rule, k::BIGINT AS occurrence, "
            f"(list_sum(list_transform(string_split_regex(text, '{p}')[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start, "
            f"length(found[k])::BIGINT AS length, md5(found[k]) AS digest "
            f"FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS found FROM {documents}), unnest(generate_series(1, len(found))) AS u(k)"
        )
    return "\nUNION ALL\n".join(selects)
