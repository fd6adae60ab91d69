"""Deduplication in which the first row wins, by an explicit position."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import FAST_SPACE, alpha_share, words
from loomtext.operators.blocks import Block, paired
from loomtext.operators.gates import first_failure
from loomtext.session import carried, saved

#: Links of a fact that a block tells.
SOME = 4


def content_key(text: Column) -> Column:
    """MD5 of the text in lower case with runs of white space as one space."""
    return F.md5(F.regexp_replace(F.lower(text), f"(?U)[{FAST_SPACE}]+", " ").cast("binary"))


def prefix_key(text: Column, n: int = 500) -> Column:
    """MD5 of the first ``n`` characters."""
    return F.md5(F.substring(text, 1, n).cast("binary"))


def first_wins(df: DataFrame, key: Column, position: str | list[str], flag: str = "is_first") -> DataFrame:
    """``df`` with ``flag``: whether the row has the least ``position`` of its key; several columns break ties in turn.

    The least position of each key is aggregated before the shuffle and joined back, so a key that a third of all rows
    share neither sorts in one task nor, with adaptive execution, joins in one.  Rows that tie in all columns are all first.
    """
    at = F.struct(*([position] if isinstance(position, str) else position))
    keyed = df.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(at).alias("_first"))
    return keyed.join(first, keyed["_key"].eqNullSafe(first["_key"])).withColumn(flag, at.eqNullSafe(F.col("_first"))).drop("_key", "_first")


def corpus_gates(docs: DataFrame, text: str = "text", position: str = "doc_id", min_chars: int = 200, min_alpha: float = 0.4) -> DataFrame:
    """``docs`` with ``gate``: short, dup, bad or kept, tested in that order.

    A long enough text takes its key before its letters are counted, so a first copy of too few letters shadows later ones.
    """
    short = F.length(text) < min_chars
    # all that is asked of the text is asked before the key's shuffle, so the text goes through it only where the caller selects it
    long = docs.filter(~short).withColumn("_fine", alpha_share(F.col(text)) >= min_alpha)
    tried = first_wins(long, content_key(F.col(text)), position)
    tried = tried.withColumn("gate", first_failure({"dup": F.col("is_first"), "bad": F.col("_fine")})).drop("is_first", "_fine")
    return docs.filter(F.coalesce(short, F.lit(True))).withColumn("gate", F.lit("short")).unionByName(tried)


def first_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """Keys in order of their first position: (key, position)."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def contained(candidates: DataFrame, known: DataFrame, candidate: str, fact: str, threshold: float = 0.5) -> DataFrame:
    """Candidates with ``is_known``: some known text holds at least ``threshold`` of the candidate's distinct words.

    A candidate of fewer than three distinct words is never known.  Of its n words such a text holds t = ceil(threshold * n).  Leave out
    the t - l most frequent of the n: it still holds l of the others.  So texts are tallied over the rarer words alone, with l half of
    t, never over words that all texts have, and those that reach l are verified by their words.
    """
    w = lambda c: F.array_distinct(words(F.lower(c)))
    # texts and candidates meet by numbers; copies, or texts of one hash, only add to a tally, as what reaches the bound is verified by its words
    k = known.select(w(F.col(fact)).alias("_k")).filter(F.size("_k") > 0).withColumn("_id", F.xxhash64("_k"))
    c = saved(candidates.select(candidate).distinct().withColumn("_w", w(F.col(candidate))).filter(F.size("_w") >= 3).withColumn("_c", F.monotonically_increasing_id()))
    held = k.select("_id", F.explode("_k").alias("_word")).join(c.select(F.explode("_w").alias("_word")).distinct(), "_word", "left_semi")
    often = held.groupBy("_word").agg(F.count("*").alias("_often"))
    ranked = c.select("_c", F.size("_w").alias("_n"), F.explode("_w").alias("_word")).join(often, "_word")  # words that no text has say nothing
    order = ranked.groupBy("_c", "_n").agg(F.array_sort(F.collect_list(F.struct("_often", "_word"))).alias("_o"))
    order = order.withColumn("_t", F.ceil(F.col("_n") * F.lit(threshold) - 1e-9).cast("int")).withColumn("_l", F.greatest(F.ceil(F.col("_t") / 2).cast("int"), F.lit(1)))
    rarer = F.size("_o") - F.greatest(F.col("_t") - F.col("_l"), F.lit(0))
    tried = saved(order.filter(rarer > 0).select("_c", "_l", F.explode(F.slice("_o", F.lit(1), rarer)).alias("_p")).select("_c", "_l", F.col("_p._word").alias("_word")))
    pairs = tried.join(held, "_word").groupBy("_c", "_l", "_id").agg(F.count("*").alias("_m")).filter("_m >= _l").select("_c", "_id")
    hits = pairs.join(k, "_id").join(c, "_c").filter(F.size(F.array_intersect("_w", "_k")) >= F.size("_w") * F.lit(threshold)).select(candidate).distinct()
    return candidates.join(hits.withColumn("is_known", F.lit(True)), candidate, "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def _covering(threshold: float, some: int) -> Callable[[Block, str, int | None], Iterator[tuple[int, float]]]:
    def judge(block: Block, low: str, before: int | None) -> Iterator[tuple[int, float]]:
        have = set(low.split())
        if len(have) >= 3 and before:
            for i in block.at_least(have, math.ceil(len(have) * threshold - 1e-9), before)[:some].tolist():
                yield i, 1.0

    return judge


def covers(known: DataFrame, facts: DataFrame, threshold: float = 0.55, some: int = 1) -> DataFrame:
    """of, by: the first facts of a block of ``known``, ``some`` of each, that come before one of ``facts`` and hold at least ``threshold`` of its distinct words.

    Both are (_pos, _low).  A fact of fewer than three distinct words is covered by none.
    """
    return paired(known, facts.select(F.col("_pos").alias("_q"), "_low"), _covering(threshold, some), "_q").select(F.col("_q").alias("of"), F.col("_pos").alias("by"))


def learned(facts: DataFrame, fact: str, position: str, threshold: float = 0.55, log: list[int] | None = None) -> DataFrame:
    """``facts`` with ``is_learned``: what a memory keeps that takes facts one by one in order of ``position`` and refuses those that it has or nearly has.

    A fact is refused if an equal one came before, or if one that was *kept* before covers it; a refused fact covers nothing.  So acceptance
    depends on acceptance, and the answer is the first independent set in order of position.  It is found in rounds: facts that no open one covers are kept, what
    they cover is refused, and both leave; a round takes all facts at once, and there are as many as the longest chain of dependences, which ``log``
    gets with the facts that were open.  Links are never gathered: a round asks for the ``SOME`` first in each block, which tell what is kept and most of what is
    refused, and then whether one of those kept covers any of the rest.  Positions (integers) must be distinct.  Null facts are learned nothing from and not kept.
    """
    first = facts.filter(F.col(fact).isNotNull()).groupBy(fact).agg(F.min(position).alias("_at"))
    unique = saved(first.select(F.col("_at").cast("long").alias("_pos"), F.lower(F.col(fact)).alias("_low")))
    without = lambda df, gone, column: df.join(gone.select(F.col(column).alias("_pos")).distinct(), "_pos", "left_anti")
    open_, refused = unique, unique.select("_pos").limit(0)
    while n := open_.count():
        if log is not None:
            log.append(n)
        links = saved(covers(open_, open_, threshold, SOME))
        kept = saved(without(open_, links, "of"))
        gone = links.join(kept.select(F.col("_pos").alias("by")), "by", "left_semi").select(F.col("of").alias("_pos")).distinct()
        rest = saved(without(without(open_, kept, "_pos"), gone, "_pos"))
        late = saved(covers(kept, rest, threshold).select(F.col("of").alias("_pos")).distinct())
        refused = saved(refused.unionByName(gone).unionByName(late))
        open_ = saved(without(rest, late, "_pos"))
    out = without(unique, refused, "_pos").select(F.col("_pos").alias("_at"), F.lit(True).alias("is_learned"))
    return facts.join(out, F.col(position) == F.col("_at"), "left").drop("_at").withColumn("is_learned", F.coalesce("is_learned", F.lit(False)))


def enqueued(topics: DataFrame, seen: DataFrame, topic: str = "topic", position: str = "pos", cap: int = 80, key_chars: int = 80, min_chars: int = 5) -> DataFrame:
    """Topics that enter a queue of ``cap``: long enough, not seen (in lower case, whole), first of their key."""
    t = topics.withColumn(topic, F.trim(topic)).filter(F.length(topic) >= min_chars).withColumn("_key", F.substring(F.lower(topic), 1, key_chars))
    t = t.join(seen.select(F.lower(F.col(seen.columns[0])).alias("_key")).distinct(), "_key", "left_anti")
    return t.groupBy("_key").agg(F.min(F.struct(position, topic)).alias("_t")).select(F.col(f"_t.{position}"), F.col(f"_t.{topic}")).orderBy(position).limit(cap)


carried(__name__)
