"""Preference formatting of chat conversations: one prompt and two masked completions per pair.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as the prompt. What
follows is rendered as two completions, each with the spans of characters that a model is trained on: those of
assistant turns. Everything runs as DataFrame operations, with one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _render(turn: Column) -> Column:
    """Header, text and end of a turn; header marks inside a text are broken up, so that they can't be taken for turns."""
    return F.concat(_header(turn), _body(turn))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("\n"))


def _spans(turns: Column) -> Column:
    """[begin, end) of the characters of assistant turns behind their headers, in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(_header(turn))
        end = begin + F.length(_body(turn))
        own = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        spans = F.when(F.coalesce(turn["role"] == "assistant", F.lit(False)), F.concat(done["spans"], own)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def format_pairs(turns: DataFrame, pair: Column, chosen: Column, order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans), one row per pair.

    ``pair`` names the pair of a turn, ``chosen`` says whether it is of the chosen conversation. Turns go by ``order``
    (null first), then role and text; turns equal in all three count once. Turns are common while role and text are
    equal, null to null. A null role is "unknown", a null text is empty. Of a pair with one conversation the prompt is
    empty and the completion that lacks is null; of two equal conversations both completions are empty. Rows with a
    null pair belong to none. Other columns are not read. An empty table gives no rows. A pair is one row of the result,
    so a task holds its turns at once.
    """
    turn = F.struct(F.col(order).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(False)).alias("is_chosen"), turn.alias("turn")).where("pair_id IS NOT NULL")
    side = lambda wanted: F.array_sort(F.collect_set(F.when(F.col("is_chosen") == wanted, F.col("turn"))))
    both = rows.groupBy("pair_id").agg(side(True).alias("a"), side(False).alias("b"))
    said = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    equal = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & said(x).eqNullSafe(said(y)))
    first = F.array_position(equal, False)
    split = both.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    joined = lambda c: F.array_join(F.transform(c, _render), "")
    there = lambda c, x: F.when(F.size(c) > 0, x)
    return split.select(
        "pair_id",
        "n_common",
        joined(F.slice("a", F.lit(1), F.col("n_common"))).alias("prompt"),
        there("a", joined(rest("a"))).alias("chosen"),
        there("b", joined(rest("b"))).alias("rejected"),
        there("a", _spans(rest("a"))).alias("chosen_spans"),
        there("b", _spans(rest("b"))).alias("rejected_spans"),
    )


def answer_swaps(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pairs from conversations alone, as turns (pair_id, is_chosen, turn, role, text); the pair is named as its conversation.

    A conversation is the chosen one. The rejected one is the same up to its last assistant turn, which has the last
    assistant text of the conversation whose number differs in the lowest bit; it ends there. Where either has no
    assistant turn, both are the conversation itself. Of equally numbered assistant turns the last is the one with the
    largest text, null smallest. Rows with a null conversation belong to none. Other columns are not read.
    """
    rows = turns.select(*(F.col(c).alias(n) for c, n in ((conv, "conv"), (order, "turn"), (role, "role"), (text, "text")))).where("conv IS NOT NULL")
    last = rows.where("role = 'assistant'").groupBy("conv").agg(F.max(F.struct("turn", "text")).alias("last"))
    swap = last.select(F.col("conv").bitwiseXOR(1).alias("conv"), F.struct(F.col("last.text").alias("text")).alias("swap"))
    both = rows.join(last.join(swap, "conv"), "conv", "left")
    at, end = F.struct("turn", "role", "text"), F.struct(F.col("last.turn"), F.lit("assistant").alias("role"), F.col("last.text"))
    is_last = F.col("turn").eqNullSafe(F.col("last.turn")) & F.col("text").eqNullSafe(F.col("last.text")) & F.coalesce(F.col("role") == "assistant", F.lit(False))
    of = lambda chosen, said: F.struct(F.lit(chosen).alias("is_chosen"), said.alias("text"))
    own = of(True, F.col("text"))
    rejected = F.when(F.col("swap").isNull(), of(False, F.col("text"))).when(is_last, of(False, F.col("swap.text"))).when(at < end, of(False, F.col("text")))
    sides = both.select("conv", "turn", "role", F.explode(F.array_compact(F.array(own, rejected))).alias("side"))
    return sides.select(F.col("conv").alias("pair_id"), "side.is_chosen", "turn", "role", "side.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every conversation against itself with another last answer; spans as text."""
    turns = answer_swaps(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = format_pairs(turns, F.col("pair_id"), F.col("is_chosen"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.withColumns({"chosen_spans": text("chosen_spans"), "rejected_spans": text("rejected_spans")})


ORACLE_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth FROM t
), l AS (
  SELECT conv_id, max(nth) AS last FROM o WHERE role = 'assistant' GROUP BY conv_id
), s AS (
  SELECT l.conv_id, l.last, b.text AS swap FROM l JOIN l k ON k.conv_id = xor(l.conv_id, 1) JOIN o b ON b.conv_id = k.conv_id AND b.nth = k.last
), u AS (
  SELECT conv_id, 0 AS side, turn, role, text FROM t
  UNION SELECT o.conv_id, 1, turn, role, CASE WHEN nth = last THEN swap ELSE text END FROM o LEFT JOIN s ON s.conv_id = o.conv_id WHERE last IS NULL OR nth <= last
), r AS (
  SELECT conv_id AS pair_id, side, role, text,
         row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS header,
         replace(coalesce(text, ''), '<|', '< |') || chr(10) AS body FROM u
), m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
         a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM r WHERE side = 0) a FULL JOIN (SELECT * FROM r WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos
), n AS (
  SELECT pair_id, (coalesce(min(pos) FILTER (WHERE NOT same) - 1, max(pos)))::INTEGER AS n_common FROM m GROUP BY pair_id
), c AS (
  SELECT r.*, n.n_common, pos > n_common AS own,
         (sum(CASE WHEN pos > n_common THEN length(header) + length(body) ELSE 0 END) OVER (PARTITION BY r.pair_id, side ORDER BY pos))::BIGINT AS upto
  FROM r JOIN n ON r.pair_id = n.pair_id
)
SELECT pair_id, n_common,
       coalesce(string_agg(header || body, '' ORDER BY pos) FILTER (WHERE side = 0 AND NOT own), '') AS prompt,
       CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(header || body, '' ORDER BY pos) FILTER (WHERE side = 0 AND own), '') END AS chosen,
       CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(header || body, '' ORDER BY pos) FILTER (WHERE side = 1 AND own), '') END AS rejected,
       CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg((upto - length(body)) || '-' || upto, ',' ORDER BY pos) FILTER (WHERE side = 0 AND own AND role = 'assistant'), '') END AS chosen_spans,
       CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg((upto - length(body)) || '-' || upto, ',' ORDER BY pos) FILTER (WHERE side = 1 AND own AND role = 'assistant'), '') END AS rejected_spans
FROM c GROUP BY pair_id, n_common
"""
