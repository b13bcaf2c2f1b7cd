"""Preference formatting: chosen and rejected conversations to a shared prompt
and two masked completions.

The longest common turn prefix of the two conversations (equal role and text)
is rendered once as ``prompt``; what follows is rendered as ``chosen`` and
``rejected``.  The masks are spans of code points, half open, in which a
trainer takes the loss: the assistant turns' texts with their end mark.
Only native expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import successors

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
TURN = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:bigint,stop:bigint>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation as one array in turn order (nulls
    first; ties by role, then text).  Null roles and texts count as empty;
    turns without a conversation id belong to none and are left out."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(turn)).alias("ts"))
            .select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
                    .alias("turns")))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SHUT))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Spans of the rendered string that assistant turns fill."""

    def merge(acc, t):
        start = acc["at"] + F.length(_head(t))
        stop = start + F.length(t["text"]) + len(END)
        span = F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))
        return F.struct(stop.cast("long").alias("at"),
                        F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(turns, zero, merge)["spans"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs``: (pair_id, chosen_turns, rejected_turns).  Returns pair_id,
    n_shared (turns in the prompt), prompt, chosen, rejected, their spans, and
    ``trainable``: both completions hold an assistant turn.  Equal
    conversations give two empty completions; no shared turn an empty prompt."""
    a, b, n = F.col("chosen_turns"), F.col("rejected_turns"), F.col("n_shared")
    rest = lambda c: F.slice(c, n + 1, F.size(c))
    out = pairs.withColumn("n_shared", common_turns(a, b)).select(
        "pair_id", "n_shared", F.slice(a, F.lit(1), n).alias("p"), rest(a).alias("c"), rest(b).alias("r"))
    out = out.select("pair_id", "n_shared", render(F.col("p")).alias("prompt"),
                     render(F.col("c")).alias("chosen"), loss_spans(F.col("c")).alias("chosen_spans"),
                     render(F.col("r")).alias("rejected"), loss_spans(F.col("r")).alias("rejected_spans"))
    return out.withColumn("trainable", (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0))


def answer_swaps(convs: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: every conversation with an
    assistant turn is chosen; rejected is the same conversation up to its last
    assistant turn, with the last assistant text of the next such conversation
    (ascending id, the last one's next is the first) in its place."""
    last = F.try_element_at(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(-1))
    base = convs.withColumn("answer", last["text"]).where(F.col("answer").isNotNull())
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), F.lit("assistant"))
    answers = base.select(F.col("conv_id").alias("next_id"), F.col("answer").alias("other"))
    swapped = F.concat(F.slice("turns", F.lit(1), at.cast("int")),
                       F.array(F.struct(F.lit("assistant").alias("role"), F.col("other").alias("text"))))
    return (base.join(successors(base.select("conv_id"), "conv_id"), "conv_id").join(answers, "next_id")
            .select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen_turns"),
                    swapped.cast(TURN).alias("rejected_turns")))


def preference_rows(turns: DataFrame) -> DataFrame:
    """All conversations of a turn table as preference rows, keyed by conv_id."""
    return format_preferences(answer_swaps(conversations(turns))).withColumnRenamed("pair_id", "conv_id")
