"""Preference formatting: a shared prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns (equal role and text) of the two conversations is rendered once, as the prompt; the turns
after it are rendered as the completions. A completion's mask has a character for each of its characters: 1 where the
loss counts, that is in the text and end marker of the assistant's turns, else 0. All of it is array expressions of Spark, in
one pass without a shuffle; ``pairs_of`` needs one shuffle, by conversation.

Defined results: a null array counts as an empty one, a null role as ``unknown``, a null text as an empty one, also in
comparisons; markers that stand in a role or text are broken up, so that no text can forge a turn; if one conversation begins
the other, its completion is empty, if they are equal, both are; the turns' order is theirs in the arrays. In ``pairs_of``
rows without a conv_id are dropped, exactly repeated rows count once, turns of equal number go by role, then text, nulls
first; conversations without an assistant's turn give no pair. Other columns don't matter; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import index_of, pick, positional

BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _clean(turns: Column) -> Column:
    """Turns without nulls and forged markers."""

    def one(t: Column) -> Column:
        return F.struct(_safe(F.coalesce(t["role"], F.lit("unknown"))).alias("role"), _safe(F.coalesce(t["text"], F.lit(""))).alias("text"))

    return F.transform(F.coalesce(turns, F.array().cast(_TURNS)), one)


def _head(t: Column) -> Column:
    return F.concat(F.lit(BEGIN), t["role"], F.lit("\n"))


def _tail(t: Column) -> Column:
    return F.concat(t["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def mask(turns: Column) -> Column:
    def one(t: Column) -> Column:
        loss = F.when(t["role"] == TRAINED, F.lit("1")).otherwise(F.lit("0"))
        return F.concat(F.repeat(F.lit("0"), F.length(_head(t))), F.repeat(loss, F.length(_tail(t))))

    return F.array_join(F.transform(turns, one), "")


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two arrays have in common from their beginning."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ > 0, differ.cast("int") - 1).otherwise(F.least(F.size(a), F.size(b)))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, prompt, prompt_turns, chosen, chosen_mask, rejected, rejected_mask) of rows of (pair_id, chosen, rejected)."""
    plain = positional(pairs)
    df = plain.select(
        F.col(f"__c{index_of(pairs, 'pair_id')}").alias("pair_id"),
        *(_clean(F.col(f"__c{index_of(pairs, side)}").cast(_TURNS)).alias(side) for side in ("chosen", "rejected")),
    )
    df = df.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0))) for side in ("chosen", "rejected")}
    return df.select(
        "pair_id",
        render(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        F.col("n").alias("prompt_turns"),
        *(f(rest[side]).alias(side + suffix) for side in ("chosen", "rejected") for f, suffix in ((render, ""), (mask, "_mask"))),
    )


def pairs_of(conversations: DataFrame) -> DataFrame:
    """A (pair_id, chosen, rejected) for each conversation with an assistant's turn.

    Chosen is the conversation up to its last assistant's turn. In the rejected one the text of one of the assistant's turns,
    the (conv_id modulo their number)th, is stale: that of the assistant's turn before or, where there is none, an echo of the
    turn before (empty, if it's the first); the turns after it are the same. So the two part anywhere in the conversation.
    """
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").filter("conv_id is not null")
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("t"))
    at = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["role"].eqNullSafe(TRAINED))
    turns = turns.withColumn("at", at).filter("size(at) > 0")
    which = (F.pmod("conv_id", F.size("at")) + 1).cast("int")
    turns = turns.withColumn("which", which).withColumn("worse", F.element_at("at", F.col("which")))
    source = F.when(F.col("which") > 1, F.element_at("at", F.greatest(F.col("which") - 1, F.lit(1)))).otherwise(F.col("worse") - 1)
    turns = turns.withColumn("source", source)
    stale = F.when(F.col("source") > 0, F.element_at("t", F.greatest("source", F.lit(1)))["text"]).otherwise(F.lit(""))
    turns = turns.withColumn("stale", stale)
    held = F.slice("t", F.lit(1), F.element_at("at", -1))
    return turns.select(
        F.col("conv_id").alias("pair_id"),
        F.transform(held, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("chosen"),
        F.transform(held, lambda x, i: F.struct(x["role"].alias("role"), F.when(i + 1 == F.col("worse"), F.col("stale")).otherwise(x["text"]).alias("text"))).alias("rejected"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), a AS (
  SELECT conv_id, i, row_number() OVER w AS k, lag(i) OVER w AS before, count(*) OVER p AS n, max(i) OVER p AS li
  FROM t WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY i), p AS (PARTITION BY conv_id)
), w AS (
  SELECT conv_id, li, i AS ai, coalesce(before, i - 1) AS src FROM a WHERE k = ((conv_id % n) + n) % n + 1
), r AS (
  SELECT w.conv_id, w.li, w.ai, g.text AS good, coalesce(b.text, '') AS bad
  FROM w JOIN t g ON g.conv_id = w.conv_id AND g.i = w.ai LEFT JOIN t b ON b.conv_id = w.conv_id AND b.i = w.src
), n AS (
  SELECT *, CASE WHEN good = bad THEN li ELSE ai - 1 END AS n FROM r
), x AS (
  SELECT n.conv_id, n.n, t.i, t.i <= n.n AS shared, '<|im_start|>' || t.role || chr(10) AS head, t.text || '<|im_end|>' || chr(10) AS tail,
         (CASE WHEN t.i = n.ai THEN n.bad ELSE t.text END) || '<|im_end|>' || chr(10) AS worse, CASE WHEN t.role = 'assistant' THEN '1' ELSE '0' END AS loss
  FROM n JOIN t ON t.conv_id = n.conv_id AND t.i <= n.li
)
SELECT conv_id AS pair_id,
       coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (WHERE shared), '') AS prompt,
       CAST(n AS INTEGER) AS prompt_turns,
       coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (WHERE NOT shared), '') AS chosen,
       coalesce(string_agg(repeat('0', length(head)) || repeat(loss, length(tail)), '' ORDER BY i) FILTER (WHERE NOT shared), '') AS chosen_mask,
       coalesce(string_agg(head || worse, '' ORDER BY i) FILTER (WHERE NOT shared), '') AS rejected,
       coalesce(string_agg(repeat('0', length(head)) || repeat(loss, length(worse)), '' ORDER BY i) FILTER (WHERE NOT shared), '') AS rejected_mask
FROM x GROUP BY conv_id, n
"""
