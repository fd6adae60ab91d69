"""Preference formatting, in DataFrame operations only.

A chosen and a rejected conversation share a prefix of turns.  It is rendered once, as the prompt; what follows in
either is rendered as its completion, with the spans of the assistant's words, the only ones to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import settled

#: How a turn is written, around its role and its text (fixed values).
OPEN, CLOSE, END = "<|", "|>\n", "\n"
TRAINED_ROLE = "assistant"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns from rows (conv_id, turn, role, text).

    Turns are in order of number, then role, then text; rows that repeat all of them stay repeated.  Null roles and
    texts count as empty, null turns come first.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def by_first_turn(talks: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, chosen, rejected: conversations that open with the same turn, as pairs.

    Of each such group one is chosen, first by ending with the assistant, then by least conv_id (null last), and each other one is
    rejected against it; a group of n gives n - 1 pairs.  A conversation that opens like no other has no rejected one.
    Other columns are ignored, whatever their names.
    """
    first = F.get("turns", F.lit(0))
    talks = settled(talks.select("conv_id", "turns").withColumn("_key", F.sha2(F.concat_ws("\x1f", first["role"], first["text"]), 256)))
    rank = F.struct((F.element_at("turns", -1)["role"] != TRAINED_ROLE).alias("open"), F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id"))
    groups = talks.groupBy("_key").agg(F.min(rank)["id"].alias("chosen_id"), F.count("*").alias("_n"))
    best = groups.join(talks.select("conv_id", F.col("turns").alias("chosen")), F.col("conv_id").eqNullSafe(F.col("chosen_id")))
    best = settled(best.drop("conv_id"))
    pairs = talks.join(best, "_key").filter((F.col("_n") == 1) | ~F.col("conv_id").eqNullSafe(F.col("chosen_id")))
    alone = F.col("_n") == 1
    return pairs.select("chosen_id", F.when(~alone, F.col("conv_id")).alias("rejected_id"), "chosen", F.when(~alone, F.col("turns")).alias("rejected"))


def prefix_length(a: Column, b: Column) -> Column:
    """Turns (role and text) that both begin with; 0 if one is null."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, F.lit(False))
    return F.when(a.isNull() | b.isNull(), F.lit(0)).when(differs == 0, n).otherwise(differs - 1).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """(start, end) in code points of what to train on in the rendered turns: the assistant's text and its end mark."""
    frame = len(OPEN) + len(CLOSE) + len(END)

    def step(acc, t):
        start = acc["at"] + F.length(t["role"]) + len(OPEN) + len(CLOSE)
        to = acc["at"] + F.length(t["role"]) + F.length(t["text"]) + frame
        more = F.array(F.struct(start.cast("int").alias("start"), to.cast("int").alias("end")))
        return F.struct(to.cast("int").alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], more)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with prompt_turns, prompt, and for both sides the completion and its trained spans, in place of the turns.

    * null or empty conversation on one side: no common prefix; its completion is empty with no spans (null for null).
    * equal conversations: all is prompt, both completions are empty.  One a prefix of the other: the shorter's
      completion is empty.  Empty table: no rows.  Other columns stay, unless they have the names given here.
    """
    out = pairs.withColumn("prompt_turns", prefix_length(F.col(chosen), F.col(rejected)))
    n = F.col("prompt_turns")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    out = out.withColumn("prompt", F.coalesce(rendered(F.slice(chosen, F.lit(1), n)), F.lit("")))
    for c in (chosen, rejected):
        out = out.withColumn(f"_{c}", rest(F.col(c)))
    for c in (chosen, rejected):
        out = out.withColumn(f"{c}_completion", rendered(F.col(f"_{c}"))).withColumn(f"{c}_spans", trained_spans(F.col(f"_{c}"))).drop(f"_{c}", c)
    return out
