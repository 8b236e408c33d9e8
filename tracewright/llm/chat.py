"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest common turn prefix of the chosen and the rejected conversation (turns with the same role and text) is
rendered once, as the prompt. What follows in either is its completion; its mask lists the spans, in characters of the
completion, on which the loss is taken: each assistant text with its end mark. DataFrame functions only.

A conversation is one row, as its rendering is one string; only its turns are ever gathered.

Defined results: a null role or text counts as empty; turns with the same number are ordered by role and text, and
repeated turns are turns; conversations that are equal have empty completions; a side that is a prefix of the other has
an empty completion; a null or missing side counts as having no turns; an empty table gives no rows; columns other than
those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = "<|end|>"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns array<struct<role,text>>) in the order of the turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = F.sort_array(F.collect_list(F.struct("turn", role, text)))
    return turns.groupBy(id_col).agg(F.transform(rows, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END + "\n"))), "")


def masks(turns: Column) -> Column:
    """array<struct<start,end>>: the assistant's texts with their end marks."""
    length = lambda t: F.length(head(t)) + F.length(t["text"]) + len(END) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(head(t))
        span = F.struct(begin.alias("start"), (begin + F.length(t["text"]) + len(END)).alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + length(t)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask in place of the two columns of turns."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    c, r = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    same = F.zip_with(c, r, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)  # from 1; 0 if they nowhere differ
    keep = [x for x in pairs.columns if x not in (chosen, rejected)]
    staged = pairs.select(*keep, c.alias("__c"), r.alias("__r"), F.when(differs > 0, differs - 1).otherwise(F.size(c)).cast("int").alias("prompt_turns"))
    rest = lambda x: F.slice(F.col(x), F.col("prompt_turns") + 1, F.greatest(F.size(x) - F.col("prompt_turns"), F.lit(0)))
    return staged.select(
        *keep,
        "prompt_turns",
        rendered(F.slice("__c", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        rendered(rest("__c")).alias("chosen_text"),
        masks(rest("__c")).alias("chosen_mask"),
        rendered(rest("__r")).alias("rejected_text"),
        masks(rest("__r")).alias("rejected_mask"),
    )


def swapped(convs: DataFrame) -> DataFrame:
    """Pairs from single conversations: chosen is the conversation up to its last assistant turn; rejected has there the assistant's turn before, or else an echo of the turn before."""
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    before = F.array_max(F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") & (i + 1 < F.col("at")), i + 1)))
    staged = convs.withColumn("at", at).withColumn("before", F.coalesce(before, F.col("at") - 1))
    other = F.struct(F.lit("assistant").alias("role"), F.coalesce(F.get("turns", F.col("before") - 1)["text"], F.lit("")).alias("text"))
    upto = lambda n: F.slice("turns", F.lit(1), n)
    return staged.select(
        "conv_id",
        F.when(F.col("at").isNull(), F.col("turns")).otherwise(upto(F.coalesce("at", F.lit(0)))).alias("chosen"),
        F.when(F.col("at").isNull(), F.col("turns")).otherwise(F.concat(upto(F.coalesce(F.col("at") - 1, F.lit(0))), F.array(other))).alias("rejected"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_pairs(swapped(conversations(table(spark, sf_dir, "conversations"))))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("conv_id", "prompt_turns", "prompt", "chosen_text", text("chosen_mask").alias("chosen_mask"), "rejected_text", text("rejected_mask").alias("rejected_mask"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
l AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN pos END) AS last_pos, count(*) AS n FROM t GROUP BY conv_id),
b AS (SELECT t.conv_id, max(t.pos) AS pos FROM t JOIN l ON t.conv_id = l.conv_id WHERE t.role = 'assistant' AND t.pos < l.last_pos GROUP BY t.conv_id),
x AS (
  SELECT l.conv_id, l.last_pos, l.n, c.text AS reply, coalesce(o.text, '') AS other
  FROM l LEFT JOIN b ON b.conv_id = l.conv_id
  LEFT JOIN t c ON c.conv_id = l.conv_id AND c.pos = l.last_pos
  LEFT JOIN t o ON o.conv_id = l.conv_id AND o.pos = coalesce(b.pos, l.last_pos - 1)),
y AS (SELECT *, CASE WHEN last_pos IS NULL THEN n WHEN reply = other THEN last_pos ELSE last_pos - 1 END AS k, last_pos IS NOT NULL AND reply <> other AS differs FROM x)
SELECT y.conv_id, CAST(k AS INTEGER) AS prompt_turns,
       coalesce((SELECT string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) FROM t WHERE t.conv_id = y.conv_id AND t.pos <= y.k), '') AS prompt,
       CASE WHEN differs THEN '<|assistant|>' || chr(10) || reply || '<|end|>' || chr(10) ELSE '' END AS chosen_text,
       CASE WHEN differs THEN '14:' || (14 + length(reply) + 7) ELSE '' END AS chosen_mask,
       CASE WHEN differs THEN '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) ELSE '' END AS rejected_text,
       CASE WHEN differs THEN '14:' || (14 + length(other) + 7) ELSE '' END AS rejected_mask
FROM y
"""
