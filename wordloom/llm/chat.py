"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation several times, as it grew.  Every conversation
gets the rolling hashes of its turn prefixes; one that equals a proper prefix of
a longer one, or repeats an equal one, is dropped by anti-join.  What remains is
rendered with a template.

A rolling hash is the running sum of four 32-bit hashes of (place, turn), so it
takes a pass over a conversation's sorted turns and is never copied.  What is
dropped is decided on digests of the turns; the texts are shuffled once, for
rendering, and only those of the conversations that stay.  Texts also take part
in the decision where a conversation has turns that differ in nothing else.

Defined results: turns are ordered by (turn, role, text), nulls first; repeated
turn numbers are all kept; rows equal in every respect count as one turn.  A row
of null conv_id belongs to no other and is a conversation by itself.  Null roles
and texts differ from empty ones in the hash and render as empty.  Of equal
conversations the smallest conv_id stays, null last and once.  conv_id and turn
may have any type with an order.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, fingerprint

#: Columns of the rolling hash: four running sums of 32 bits each, with room for 2^31 turns.
HASH = ("h0", "h1", "h2", "h3")


@dataclass(frozen=True)
class ChatConfig:
    """``before``, ``between`` and ``after`` stand around role and text of a turn; ``end`` closes a conversation."""

    before: str = "<|"
    between: str = "|>\n"
    after: str = "<|end|>\n"
    end: str = ""


def _turns(rows: DataFrame) -> DataFrame:
    """who (names the conversation, never null), conv_id, turn, role, text, mark (digest of the text)."""
    rows = rows.select("conv_id", "turn", "role", "text", F.unhex(F.md5("text")).alias("mark"))
    alone = F.concat_ws("-", F.lit("row"), *(F.hex(fingerprint(F.lit(k), "turn", "role", "mark")) for k in range(2)))
    return rows.withColumn("who", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), alone))


def _rolled(turns: DataFrame, last: str) -> DataFrame:
    """who, conv_id, h0..h3, whole, tied: turns in the order of (turn, role, ``last``); ``tied`` where only that tells two of them apart."""
    order = Window.partitionBy("who").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", last)))
    alike = lambda c: F.lag(c).over(order).eqNullSafe(F.col(c))
    placed = turns.withColumns({
        "place": F.row_number().over(order),
        "whole": F.lead(F.lit(1)).over(order).isNull(),
        "tied": F.lag(F.lit(1)).over(order).isNotNull() & alike("turn") & alike("role"),
    })
    part = lambda k: F.shiftright(fingerprint(F.lit(k), "place", "role", "mark"), 32)
    sums = [F.sum(part(k)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(h) for k, h in enumerate(HASH)]
    return placed.select("who", "conv_id", *sums, "whole", "tied")


def prefixes(rows: DataFrame) -> DataFrame:
    """who, conv_id, h0..h3, whole, tied: the rolling hash after every turn, and whether it is the last one."""
    turns = _turns(rows)
    found = cut(_rolled(turns.select("who", "conv_id", "turn", "role", "mark").distinct(), "mark"))
    tied = found.where("tied").select("who").distinct()
    if tied.isEmpty():
        return found
    tied = cut(tied)
    told = turns.join(tied, "who", "left_semi").distinct()
    return found.join(tied, "who", "left_anti").unionByName(_rolled(told, "text"))


def maximal(rows: DataFrame) -> DataFrame:
    """who of the conversations that are no proper prefix of another, each content once."""
    least = F.min(F.when(F.col("whole"), F.col("conv_id"))).alias("conv_id")
    nameless = F.min(F.when(F.col("whole") & F.col("conv_id").isNull(), F.col("who"))).alias("row")
    found = prefixes(rows).groupBy(*HASH).agg(F.max(~F.col("whole")).alias("inner"), least, nameless)
    return found.where("NOT inner").select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), "row").alias("who"))


def render(rows: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """conv_id, n_turns, rendered — of the maximal conversations."""
    text = lambda c: F.coalesce(c, F.lit(""))
    kept = _turns(rows).join(maximal(rows), "who", "left_semi").select("who", "conv_id", F.struct("turn", "role", "text").alias("t"))
    found = kept.groupBy("who").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_set("t")).alias("turns"))
    turns = F.transform("turns", lambda t: F.concat(F.lit(config.before), text(t["role"]), F.lit(config.between), text(t["text"]), F.lit(config.after)))
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat(F.array_join(turns, ""), F.lit(config.end)).alias("rendered"))


def _quoted(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def chat_sql(config: ChatConfig = ChatConfig(), rows: str = "conversations") -> str:
    """DuckDB SQL of :func:`render`; prefixes are compared as lists of turns instead of hashes."""
    return f"""
WITH turns AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM (SELECT DISTINCT conv_id, turn, role, text FROM {rows})),
convs AS (
  SELECT conv_id, alone, count(*) AS n, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS parts,
    string_agg({_quoted(config.before)} || coalesce(role, '') || {_quoted(config.between)} || coalesce(text, '') || {_quoted(config.after)}, ''
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) || {_quoted(config.end)} AS rendered
  FROM turns GROUP BY conv_id, alone),
inner_prefixes AS (SELECT DISTINCT parts[1:k] AS parts FROM (SELECT parts, unnest(generate_series(1, n - 1)) AS k FROM convs)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY parts ORDER BY conv_id NULLS LAST) AS nth FROM convs)
SELECT c.conv_id, c.n::BIGINT AS n_turns, c.rendered
FROM firsts c WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM inner_prefixes p WHERE p.parts = c.parts)
"""
