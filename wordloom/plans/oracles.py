"""DuckDB SQL for the registered queries: the same rows by relational means, without the kernel."""

from __future__ import annotations

import re

from ..functions import chars
from ..functions.kernel import CLEANUPS
from .fixture import model


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SINGLE = chars.class_body(chars.ASCII_PUNCTUATION_RANGES, True) + r"\p{P}" + chars.class_body(chars.IDEOGRAPH_RANGES, True)
_WHITE = chars.class_body(chars.WHITESPACE_RANGES, True)
_M = model()
UNK, CLS, SEP, PAD = _M.unk[1], _M.cls[1], _M.sep[1], _M.pad[1]


def _tokens(table: dict[str, int], is_suffix: bool) -> str:
    words, ids = (_text(" ".join(map(str, x))) for x in (table.keys(), table.values()))
    return f"SELECT unnest(string_split({words}, ' ')) AS token, {is_suffix} AS is_suffix, unnest(string_split({ids}, ' ')::BIGINT[]) AS id"


VOCAB = f"vocab AS MATERIALIZED ({_tokens(_M.prefixes, False)} UNION ALL {_tokens(_M.suffixes, True)})"
_LONGEST = max(len(t) for t in [*_M.prefixes, *_M.suffixes])


_SPECIALS = "|".join(re.escape(t.content) for t in _M.added)


def segments(table: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """segs(keys, pos from 0, seg, start, n_chars): all segments with their offsets."""
    return f"""
runs AS (
  SELECT {keys}, length({text}) AS n_chars, unnest(found) AS seg, unnest(generate_series(1, len(found))) AS run
  FROM (SELECT *, regexp_extract_all({text}, '[{_WHITE}]+|{_SPECIALS}|[{_SINGLE}]|[^{_SINGLE}{_WHITE}]+') AS found FROM {table})),
placed AS (SELECT *, sum(length(seg)) OVER (PARTITION BY {keys} ORDER BY run) - length(seg) AS start FROM runs),
segs AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY run) - 1 AS pos, seg, start::BIGINT AS start, n_chars
  FROM placed WHERE NOT regexp_matches(seg, '^[{_WHITE}]'))"""


_APART = "list_aggregate(list_transform(string_split(word, ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || chr(769) ELSE c END), 'string_agg', '')"

def _pieces(decomposed: bool) -> str:
    """word_ids(word, ids, failed): pieces of every distinct word, and those of the attempts that failed before."""
    apart = "UNION ALL SELECT word, 2, apart FROM forms WHERE apart <> word" if decomposed else ""
    return f"""
words AS (SELECT DISTINCT lower(seg) AS word FROM segs),
forms AS (SELECT word, {_APART} AS apart, strip_accents(word) AS bare FROM words),
attempts AS (
  SELECT word, 1 AS step, word AS form FROM forms
  {apart}
  UNION ALL SELECT word, 3, bare FROM forms WHERE bare <> {'apart' if decomposed else 'word'}),
greedy AS (
  SELECT form, form AS rest, []::BIGINT[] AS ids, 0 AS k FROM (SELECT DISTINCT form FROM attempts)
  UNION ALL
  SELECT form, substr(rest, size + 1), list_append(ids, id), k + 1 FROM (
    SELECT g.form, g.rest, g.ids, g.k, v.id, l.size
    FROM greedy g CROSS JOIN (SELECT unnest(generate_series(1, {_LONGEST})) AS size) l
    JOIN vocab v ON v.token = substr(g.rest, 1, l.size) AND length(v.token) = l.size AND v.is_suffix = (g.k > 0)
    QUALIFY row_number() OVER (PARTITION BY g.form ORDER BY l.size DESC) = 1)),
matched AS (SELECT form, arg_max(ids, k) AS ids, arg_max(rest, k) = '' AS whole FROM greedy GROUP BY form),
tried AS (SELECT a.word, a.step, m.ids, m.whole, min(CASE WHEN m.whole THEN a.step END) OVER (PARTITION BY a.word) AS won FROM attempts a JOIN matched m USING (form)),
word_ids AS (
  SELECT word, coalesce(any_value(ids) FILTER (WHERE step = won), [{UNK}::BIGINT]) AS ids,
    coalesce(list(ids ORDER BY step) FILTER (WHERE won IS NULL OR step < won), []) AS failed
  FROM tried GROUP BY word)"""


PIECES = _pieces(True)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([VOCAB, *parts])


def _base(table: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    return _with(segments(table, keys, text), PIECES)


_JOIN = lambda ids: f"array_to_string({ids}, ' ')"


def vocab() -> str:
    return f"{_with()} SELECT token, is_suffix, id FROM vocab"


def vocab_lookup() -> str:
    return f"""{_with()} SELECT i.id, CASE WHEN is_suffix THEN '##' ELSE '' END || token AS token
FROM (SELECT unnest(generate_series(-1, (SELECT max(id) FROM vocab) + 1))::BIGINT AS id) i LEFT JOIN vocab v ON i.id = v.id"""


def pretokenize() -> str:
    return f"WITH {segments()} SELECT doc_id, count(*) AS n, string_agg(lower(seg), ' ' ORDER BY pos) AS segments, string_agg(start::VARCHAR, ' ' ORDER BY pos) AS starts FROM segs GROUP BY doc_id"


def word_functions() -> str:
    return f"""WITH {segments()}
SELECT seg AS word, lower(seg) AS low, strip_accents(lower(seg)) AS bare, seg AS clean, count(*) AS n FROM segs GROUP BY seg"""


def wordpiece_words() -> str:
    return f"{_base()} SELECT word, {_JOIN('ids')} AS ids FROM word_ids"


def encode_full(table: str = "documents", key: str = "doc_id") -> str:
    return f"""{_base(table, key)}, pieces AS (SELECT {key}, flatten(list(ids ORDER BY pos)) AS ids FROM segs JOIN word_ids ON word = lower(seg) GROUP BY {key})
SELECT d.{key}, (2 + len(coalesce(ids, [])))::BIGINT AS n_tokens, {_JOIN(f'[{CLS}] || coalesce(ids, []) || [{SEP}]')} AS ids
FROM {table} d LEFT JOIN pieces USING ({key})"""


#: Documents with special tokens inside their words, as text.
MARKED = "(SELECT doc_id, 'doc[CLS]' || doc_id::VARCHAR || '[SEP]end ' || text AS text FROM documents)"


def added_tokens() -> str:
    own = ", ".join(_text(t.content) for t in _M.added)
    return f"""WITH {segments(MARKED)}
SELECT doc_id, string_agg(CASE WHEN seg IN ({own}) THEN seg ELSE lower(seg) END, ' ' ORDER BY pos) AS segments FROM segs GROUP BY doc_id"""


def encode_vocab_txt() -> str:
    """Of a vocab.txt the special tokens are found in texts but are unknown there, as lower case makes them here."""
    return encode_full(MARKED)


#: Every document twice, the copies in sequence; the smallest id is null.
TWICE = "(SELECT nullif(doc_id, (SELECT min(doc_id) FROM documents)) AS doc_id, doc_id * 2 + copy AS nth, text FROM documents, (SELECT unnest([0, 1]) AS copy) c)"


def memoised_repeated_keys() -> str:
    return f"SELECT d.doc_id, e.n_tokens, e.ids FROM ({encode_full(TWICE, 'nth')}) e JOIN {TWICE} d USING (nth)"


def passages_repeated_keys(size: int) -> str:
    return f"SELECT t.doc_id, p.chunk, p.passage FROM ({passages(size)}) p JOIN {TWICE} t ON p.doc_id = t.nth // 2"


def prompt_encode(prefix: str, limit: int) -> str:
    return encode_padded(limit, f"(SELECT item_id, {_text(prefix)} || text AS text FROM benchmark)", "item_id")


def _truncated(limit: int, table: str = "documents", keys: str = "doc_id") -> str:
    """encoded(keys, ids): the base tables and truncated encodings."""
    join = " AND ".join(f"d.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""{_base(table, keys)},
spent AS (
  SELECT {keys}, pos, ids, failed, {limit} - 1 - (sum(len(ids)) OVER (PARTITION BY {keys} ORDER BY pos) - len(ids)) AS room
  FROM segs JOIN word_ids ON word = lower(seg)),
chosen AS (
  SELECT {keys}, pos, room, coalesce(list_filter(failed, lambda f: len(f) >= room)[1], ids)[1:room] AS got FROM spent WHERE room > 1),
ended AS (SELECT *, min(CASE WHEN len(got) >= room - 1 THEN pos END) OVER (PARTITION BY {keys}) AS last FROM chosen),
kept AS (SELECT {keys}, flatten(list(got[1:room - 1] ORDER BY pos)) AS ids FROM ended WHERE last IS NULL OR pos <= last GROUP BY {keys}),
encoded AS (
  SELECT {", ".join(f"d.{k.strip()}" for k in keys.split(","))}, [{CLS}] || coalesce(p.ids, []) || [{SEP}] AS ids
  FROM {table} d LEFT JOIN kept p ON {join})"""


def encode_truncated(limit: int) -> str:
    return f"{_truncated(limit)} SELECT doc_id, len(ids)::BIGINT AS n_tokens, {_JOIN('ids')} AS ids FROM encoded"


def encode_padded(limit: int, table: str = "documents", key: str = "doc_id") -> str:
    fill = lambda x: f"list_resize([]::BIGINT[], {limit} - len(ids), {x})"
    ones = "list_resize([]::BIGINT[], len(ids), 1)"
    return f"""{_truncated(limit, table, key)} SELECT {key}, {_JOIN(f'ids || {fill(PAD)}')} AS input_ids, {_JOIN(f'{ones} || {fill(0)}')} AS attention_mask,
  {_JOIN(f'list_resize([]::BIGINT[], {limit}, 0)')} AS token_type_ids FROM encoded"""


def chat_encode() -> str:
    return f"""{_base('conversations', 'conv_id, turn')}, pieces AS (SELECT conv_id, turn, flatten(list(ids ORDER BY pos)) AS ids FROM segs JOIN word_ids ON word = lower(seg) GROUP BY conv_id, turn)
SELECT d.conv_id, d.turn, (2 + len(coalesce(ids, [])))::BIGINT AS n_tokens, {_JOIN(f'[{CLS}] || coalesce(ids, []) || [{SEP}]')} AS ids
FROM conversations d LEFT JOIN pieces p ON d.conv_id = p.conv_id AND d.turn = p.turn"""


def chunked(size: int, stride: int, decomposed: bool = True) -> str:
    """chunks(doc_id, chunk, at, following, ids): the base tables and every chunk, by recursion over a document's chunks."""
    return f"""{_with(segments(), _pieces(decomposed))},
listed AS MATERIALIZED (
  SELECT doc_id, pos + 1 AS i, ids, failed, start, start + length(seg) AS finish, n_chars,
    sum(len(ids)) OVER (PARTITION BY doc_id ORDER BY pos) - len(ids) AS before, count(*) OVER (PARTITION BY doc_id) AS m
  FROM segs JOIN word_ids ON word = lower(seg)),
chain AS (
  SELECT doc_id, -1 AS chunk, 0::BIGINT AS began, 0::BIGINT AS following, 1::BIGINT AS nth, []::BIGINT[] AS ids, false AS lost FROM documents
  UNION ALL
  SELECT doc_id, chunk + 1, following, CASE WHEN jump THEN CASE WHEN nth < m THEN finish END ELSE next END, CASE WHEN jump THEN nth + 1 ELSE i END,
    tail || body, first AND crowded
  FROM (
    SELECT *, next IS NOT NULL AND next <= following AND i = nth AS jump FROM (
      SELECT doc_id, chunk, following, nth, tail, any_value(m) AS m,
        coalesce(flatten(list(CASE WHEN i < last OR last IS NULL THEN got WHEN crowded AND NOT first AND {stride} > 0 THEN [] ELSE got[1:room - 1] END ORDER BY i) FILTER (WHERE i IS NOT NULL AND (last IS NULL OR i <= last))), []) AS body,
        any_value(CASE WHEN crowded THEN CASE WHEN NOT first THEN start END WHEN n_chars > finish THEN start END) FILTER (WHERE i = last) AS next,
        any_value(i) FILTER (WHERE i = last) AS i, any_value(finish) FILTER (WHERE i = last) AS finish,
        coalesce(any_value(crowded) FILTER (WHERE i = last), false) AS crowded, coalesce(any_value(first) FILTER (WHERE i = last), false) AS first
      FROM (
        SELECT *, min(CASE WHEN len(got) >= room - 1 THEN i END) OVER (PARTITION BY doc_id) AS last, len(got) >= room AS crowded, before = opening AS first FROM (
          SELECT *, coalesce(list_filter(failed, lambda f: len(f) >= room)[1], ids)[1:room] AS got FROM (
            SELECT c.doc_id, c.chunk, c.following, c.nth, c.tail, w.i, w.ids, w.failed, w.start, w.finish, w.n_chars, w.m, w.before,
              min(w.before) OVER (PARTITION BY c.doc_id) AS opening,
              {size} - 1 - len(c.tail) - (w.before - min(w.before) OVER (PARTITION BY c.doc_id)) AS room
            FROM (SELECT *, CASE WHEN {stride} > 0 AND chunk >= 0 THEN ids[greatest(1, len(ids) - {stride} + 1):] ELSE [] END AS tail FROM chain WHERE following IS NOT NULL) c
            LEFT JOIN listed w ON w.doc_id = c.doc_id AND w.i BETWEEN c.nth AND c.nth + {size})
          WHERE room > 1 OR i IS NULL))
      GROUP BY doc_id, chunk, following, nth, tail))),
chunks AS (SELECT doc_id, chunk::BIGINT AS chunk, began AS "offset", following AS next_offset, [{CLS}] || ids || [{SEP}] AS ids, lost FROM chain WHERE chunk >= 0)"""


def chunk_rows(size: int, stride: int, decomposed: bool = True) -> str:
    return f"""{chunked(size, stride, decomposed)} SELECT doc_id, chunk, "offset", next_offset, len(ids)::BIGINT AS n_tokens, {_JOIN('ids')} AS ids, lost AS truncated_tail FROM chunks"""


def batches(size: int, batch: int) -> str:
    return f"""{chunked(size, 0)}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk) - 1 AS n FROM chunks), total AS (SELECT count(*) AS n FROM numbered)
SELECT n // {batch} AS batch_id, n % {batch} AS row_in_batch, doc_id, "offset", len(ids)::BIGINT AS n_tokens FROM numbered
UNION ALL SELECT n // {batch}, r, NULL, NULL, NULL FROM (SELECT n, unnest(generate_series(n % {batch}, {batch} - 1)) AS r FROM total WHERE n % {batch} > 0)"""


def batches_repeated_keys(size: int, batch: int) -> str:
    return f"""{chunked(size, 0)},
twice AS (SELECT nullif(doc_id, (SELECT min(doc_id) FROM documents)) AS key, copy, chunk, "offset", len(ids)::BIGINT AS n_tokens FROM chunks, (SELECT unnest([0, 1]) AS copy) c),
numbered AS (SELECT *, row_number() OVER (ORDER BY key NULLS FIRST, copy, chunk) - 1 AS n FROM twice), total AS (SELECT count(*) AS n FROM numbered)
SELECT n // {batch} AS batch_id, n % {batch} AS row_in_batch, key AS doc_id, "offset", n_tokens FROM numbered
UNION ALL SELECT n // {batch}, r, NULL, NULL, NULL FROM (SELECT n, unnest(generate_series(n % {batch}, {batch} - 1)) AS r FROM total WHERE n % {batch} > 0)"""


def packed_batches(size: int, batch: int) -> str:
    full = f"ids || list_resize([]::BIGINT[], {size} - len(ids), {PAD})"
    return f"""{chunked(size, 0)}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk) - 1 AS n FROM chunks), total AS (SELECT count(*) AS n FROM numbered),
rows AS (
  SELECT n // {batch} AS batch_id, n % {batch} AS r, concat_ws(':', doc_id, "offset", next_offset) AS place, {_JOIN(full)} AS ids FROM numbered
  UNION ALL SELECT n // {batch}, r, '', {_JOIN(f'list_resize([]::BIGINT[], {size}, 0)')} FROM (SELECT n, unnest(generate_series(n % {batch}, {batch} - 1)) AS r FROM total WHERE n % {batch} > 0))
SELECT batch_id, string_agg(place, ' ' ORDER BY r) AS correlation, string_agg(ids, ' ' ORDER BY r) AS input_ids FROM rows GROUP BY batch_id"""


def partition_batches(size: int, batch: int) -> str:
    return f"""{chunked(size, 0)} SELECT doc_id, chunk, "offset", len(ids)::BIGINT AS n_tokens, {batch}::BIGINT AS rows_of_batch FROM chunks"""


def decode_full() -> str:
    cleaned = "string_agg(shown, '' ORDER BY nth)"
    for before, after in CLEANUPS:
        cleaned = f"replace({cleaned}, {_text(before)}, {_text(after)})"
    return f"""{_base()}, flat AS (
  SELECT doc_id, unnest([{CLS}] || coalesce(ids, []) || [{SEP}]) AS id, unnest(generate_series(1, len(coalesce(ids, [])) + 2)) AS nth
  FROM documents LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM segs JOIN word_ids ON word = lower(seg) GROUP BY doc_id) USING (doc_id)),
shown AS (SELECT doc_id, nth, CASE WHEN nth = 1 OR is_suffix OR token IN ('.', '?', '!', ',') THEN token ELSE ' ' || token END AS shown FROM flat JOIN vocab USING (id))
SELECT doc_id, {cleaned} AS text FROM shown GROUP BY doc_id"""


def statistics(group: str) -> str:
    return f"""{_base(keys=f'doc_id, {group}')}
SELECT {group}, sum(len(ids))::BIGINT AS n_tokens, sum(len(list_filter(ids, lambda x: x = {UNK})))::BIGINT AS n_unknown FROM segs JOIN word_ids ON word = lower(seg) GROUP BY {group}"""


def unit_norm() -> str:
    scaled = "list_transform(embedding, lambda x: x::DOUBLE * 2.5)"
    length = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
    return f"""SELECT vec_id, (pos - 1)::BIGINT AS pos, round(v[pos] / {length}, 6) AS value
FROM (SELECT vec_id, {scaled} AS v, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)"""


def semantic_topk(k: int) -> str:
    product = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"""SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, {product} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= {k}"""


def passages(size: int) -> str:
    return f"""{chunked(size, 0)} SELECT c.doc_id, c.chunk, substr(d.text, c."offset" + 1, coalesce(c.next_offset, length(d.text)) - c."offset") AS passage
FROM chunks c JOIN documents d USING (doc_id)"""


def pending(size: int) -> str:
    return f"""{chunked(size, 0)}, done AS (SELECT doc_id FROM chunks WHERE next_offset IS NULL AND chunk % 2 = 0)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done)"""


def upserted(size: int) -> str:
    return f"""{chunked(size, 0)} SELECT doc_id, "offset", CASE WHEN chunk % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM chunks"""


def json_map() -> str:
    return "SELECT item_id AS key, text FROM benchmark"
