"""Retrieval of facts and routing of messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import words

#: Words that route a message to a tool, in order.
SEARCH = ("cherche", "search", "trouve", "c'est quoi", "qu'est-ce", "who is", "what is", "actualité")
DATE = ("date", "heure", "time", "jour")
#: What makes a sentence a denial, and the words of the memory's text.
NEGATIONS = (" pas ", " non ", " jamais ", " aucun ", " false ", " not ")
PREFERENCES, FACTS, NOTHING = "Préférences: ", "Faits connus:", "(mémoire vide)"


def score(fact: Column, query: str) -> Column:
    """1 if the fact contains the query (any case), else the share of the query's distinct words that it has."""
    q = F.lit(query.lower())
    have = F.array_distinct(words(q))
    return F.when(F.lower(fact).contains(query.lower()), 1.0).otherwise(F.size(F.array_intersect(have, words(F.lower(fact)))) / F.greatest(F.size(have), F.lit(1)))


def search(facts: DataFrame, query: str, k: int = 5, fact: str = "fact", position: str = "pos") -> DataFrame:
    """The ``k`` best facts of a score above 0; of equal ones, those that came first."""
    return facts.withColumn("score", score(F.col(fact), query)).filter("score > 0").orderBy(F.desc("score"), position).limit(k)


def told(preferences: DataFrame) -> DataFrame:
    """One row with ``_prefs``: the preferences (key, value) as the inside of a JSON object, by key; empty if there are none."""
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    pairs = F.array_sort(F.collect_list(F.struct("key", F.concat(quoted("key"), F.lit(": "), quoted("value")).alias("said"))))
    return preferences.agg(F.array_join(F.transform(pairs, lambda x: x["said"]), ", ").alias("_prefs"))


def context(facts: DataFrame, preferences: DataFrame, query: str | None, n: int = 10, fact: str = "fact", position: str = "pos") -> DataFrame:
    """One row with ``context``, what a prompt is told: preferences as JSON, then the facts found, or without a query the last, one to a line.

    What there is none of is left out; if both are missing the text says so.  Preferences are rows (key, value), told by key.
    """
    chosen = search(facts, query, n, fact, position) if query else facts.orderBy(F.desc(position)).limit(n)
    best = F.struct(-F.col("score"), position, fact) if query else F.struct(position, fact)
    lines = chosen.agg(F.array_join(F.transform(F.array_sort(F.collect_list(best)), lambda x: F.concat(F.lit("- "), x[fact])), "\n").alias("_facts"))
    part = lambda c, head, tail="": F.when(F.col(c) != "", F.concat(F.lit(head), F.col(c), F.lit(tail)))
    text = F.concat_ws("\n", part("_prefs", PREFERENCES + "{", "}"), part("_facts", FACTS + "\n"))
    return told(preferences).join(lines).select(F.when(text == "", F.lit(NOTHING)).otherwise(text).alias("context"))  # two tables of one row each


def contradicted(facts: DataFrame, candidates: DataFrame, negations: tuple[str, ...] = NEGATIONS, last: int = 50, prefix: int = 40, fact: str = "fact", position: str = "pos") -> DataFrame:
    """Candidates with ``is_contradicted``: they hold a negation, and they or one of the last 50 facts contain the other's first 40 characters.

    The negation is looked for in lower case, the characters as they are.  The facts compared are 50 rows at most, so they are broadcast.
    """
    recent = facts.orderBy(F.desc(position)).limit(last).select(F.col(fact).alias("_f"))
    meets = _any(F.lower(fact), negations) & (F.col(fact).contains(F.substring("_f", 1, prefix)) | F.col("_f").contains(F.substring(fact, 1, prefix)))
    hit = candidates.join(F.broadcast(recent), meets, "left_semi").select(fact).distinct().withColumn("is_contradicted", F.lit(True))
    return candidates.join(hit, fact, "left").withColumn("is_contradicted", F.coalesce("is_contradicted", F.lit(False)))


def prioritised(queue: DataFrame, choice: str, first: int = 15, topic: str = "topic", position: str = "pos") -> DataFrame:
    """The queue turned so that it begins with the first of its first 15 topics that contains the choice or is contained; else as it is."""
    w = Window.orderBy(position)  # a queue is short by definition
    q = queue.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    low = F.lower(F.col(topic))
    hit = (F.col("_i") < first) & (F.lit(choice.lower()).contains(low) | low.contains(choice.lower()))
    start = F.coalesce(F.min(F.when(hit, F.col("_i"))).over(Window.partitionBy()), F.lit(0))
    return q.withColumn("new_pos", F.pmod(F.col("_i") - start, F.col("_n"))).drop("_i", "_n")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def route(message: Column) -> Column:
    """Which tool a message asks for: the first rule that fits."""
    low = F.lower(message)
    return F.when(_any(low, SEARCH), "search_web").when(message.rlike(r"[-+*/]") & message.rlike(r"\p{Nd}"), "calculator").when(_any(low, DATE), "get_datetime").otherwise("none")
