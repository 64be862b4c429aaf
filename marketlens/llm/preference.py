"""Preference examples from pairs of conversations, with DataFrame operations alone.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text at each
place) is rendered once, as the prompt. The turns after it are the two completions. A mask goes with each completion:
the spans of code points of the assistant's own words, which alone are to be learned.

The prefix ends at the first place where the two differ, a minimum over joined turns, so no conversation is gathered to
find it. Rendered strings are gathered per pair at the end: a conversation is one row of the result.

Turns are ordered by turn, ties by role and text; null roles and texts compare as equal to nulls and render as empty.
Rows with a null pair take no part. Equal conversations give empty completions, as does a side without turns. An empty
table gives an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNED = "assistant"


def _head(role: str) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def _placed(turns: DataFrame) -> DataFrame:
    by = Window.partitionBy("pair").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return turns.where("pair is not null").select("pair", F.row_number().over(by).alias("pos"), "role", "text")


def _side(turns: DataFrame, shared: DataFrame, side: str) -> DataFrame:
    """(pair, prompt, side, side_mask) of the placed turns of one side."""
    body = F.coalesce("text", F.lit(""))
    shown = turns.join(shared, "pair").select("pair", "pos", (F.col("pos") <= F.col("n_common")).alias("common"), F.concat(_head("role"), body, F.lit("\n")).alias("shown"), F.char_length(_head("role")).alias("head"), F.char_length(body).alias("body"), (F.col("role") == LEARNED).alias("learned"))
    upto = F.sum(F.expr("head + body + 1")).over(Window.partitionBy("pair", "common").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    shown = shown.withColumn("start", upto - F.col("body") - 1)
    span = F.when(F.col("learned") & (F.col("body") > 0), F.concat(F.col("start").cast("string"), F.lit("-"), (F.col("start") + F.col("body")).cast("string")))
    text = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "shown")))), lambda x: x["shown"]), "")
    mask = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("common") & span.isNotNull(), F.struct("pos", span.alias("span"))))), lambda x: x["span"]), ",")
    return shown.groupBy("pair").agg(text(F.col("common")).alias(f"prompt_{side}"), text(~F.col("common")).alias(side), mask.alias(f"{side}_mask"))


def preference_examples(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Two tables of turns (pair, turn, role, text) -> one row for each pair.

    pair, n_common (turns of the prompt), prompt, chosen, rejected, chosen_mask, rejected_mask ("start-end" spans in
    the completion, joined by commas).
    """
    one, two = _placed(chosen), _placed(rejected)
    theirs = two.select("pair", "pos", F.col("role").alias("their_role"), F.col("text").alias("their_text"), F.lit(True).alias("there"))
    both = one.withColumn("here", F.lit(True)).join(theirs, ["pair", "pos"], "full")
    equal = F.col("here").isNotNull() & F.col("there").isNotNull() & F.col("role").eqNullSafe(F.col("their_role")) & F.col("text").eqNullSafe(F.col("their_text"))
    shared = both.groupBy("pair").agg((F.coalesce(F.min(F.when(~equal, F.col("pos"))), F.max("pos") + 1) - 1).cast("long").alias("n_common"))
    out = shared.join(_side(one, shared, "chosen"), "pair", "left").join(_side(two, shared, "rejected"), "pair", "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return out.select("pair", "n_common", empty("prompt_chosen").alias("prompt"), *[empty(c).alias(c) for c in ("chosen", "rejected", "chosen_mask", "rejected_mask")])


def pairs_from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations (conv_id, turn, role, text) -> turns of the chosen and of the rejected conversations, by pair.

    Each conversation is chosen over its own copy in which the last assistant turn, and what follows it, gives way to
    the last assistant turn of the conversation with the next higher id in use, if that id is one higher. Without such
    a turn of its own or a neighbour's, the copy ends before the turn.
    """
    turns = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = turns.where(F.col("role") == LEARNED).groupBy("pair").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    last = last.select("pair", F.col("last.turn").alias("at"), F.col("last.text").alias("said"))
    kept = turns.join(last.select("pair", "at"), "pair", "left").where("at is null or turn < at").select("pair", "turn", "role", "text")
    other = last.select((F.col("pair") - 1).alias("pair"), F.col("said").alias("text"))
    ends = last.select("pair", F.col("at").alias("turn")).join(other, "pair").select("pair", "turn", F.lit(LEARNED).alias("role"), "text")
    return turns, kept.unionByName(ends)


PREFERENCE_SQL = """
WITH turns AS (SELECT conv_id AS pair, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair, max({'turn': turn, 'text': coalesce(text, '')}) AS x FROM turns WHERE role = 'assistant' GROUP BY pair),
kept AS (SELECT t.* FROM turns t LEFT JOIN last l USING (pair) WHERE l.x IS NULL OR t.turn < l.x.turn),
made AS (SELECT * FROM kept UNION ALL SELECT l.pair, l.x.turn, 'assistant', o.x.text FROM last l JOIN last o ON o.pair = l.pair + 1),
one AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text FROM turns),
two AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text FROM made),
shared AS (
  SELECT coalesce(a.pair, b.pair) AS pair,
    coalesce(min(coalesce(a.pos, b.pos)) FILTER (WHERE a.pos IS NULL OR b.pos IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text),
      max(coalesce(a.pos, b.pos)) + 1) - 1 AS n_common
  FROM one a FULL JOIN two b ON a.pair = b.pair AND a.pos = b.pos GROUP BY 1),
shown AS (
  SELECT side, pair, pos, pos <= n_common AS common, role, coalesce(text, '') AS body, '<|' || coalesce(role, '') || '|>' || chr(10) AS head
  FROM (SELECT 'c' AS side, * FROM one UNION ALL SELECT 'r', * FROM two) JOIN shared USING (pair)),
spans AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY side, pair, common ORDER BY pos) - length(body) - 1 AS start FROM shown),
sides AS (
  SELECT side, pair, coalesce(string_agg(head || body || chr(10), '' ORDER BY pos) FILTER (WHERE common), '') AS prompt,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY pos) FILTER (WHERE NOT common), '') AS said,
    coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE NOT common AND role = 'assistant' AND length(body) > 0), '') AS mask
  FROM spans GROUP BY side, pair)
SELECT s.pair AS pair_id, CAST(n_common AS BIGINT) AS n_common, coalesce(c.prompt, '') AS prompt, coalesce(c.said, '') AS chosen, coalesce(r.said, '') AS rejected,
  coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM shared s LEFT JOIN sides c ON c.pair = s.pair AND c.side = 'c' LEFT JOIN sides r ON r.pair = s.pair AND r.side = 'r'
"""
