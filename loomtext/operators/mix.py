"""Mixing sources, budgets, quotas, chunks and shards.

A weighted random interleave of sources is had without a loop: row i of source s arrives at the time
``sum of i exponential gaps / weight``, and rows are read by arrival.  Superposed Poisson processes pick source s with
probability ``weight / sum of weights`` at each step and renormalise as sources run out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import strip
from loomtext.operators.dedup import first_wins, prefix_key
from loomtext.operators.gates import good as good_text
from loomtext.session import saved

#: Rows of a block of a running sum, and the fewest blocks.
BLOCK_ROWS, LEAST_BLOCKS = 1 << 18, 64


def uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone; the MD5 makes it the same in any engine."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def arrivals(docs: DataFrame, weights: dict[str, float], source: str = "source", position: str = "doc_id", seed: int = 42) -> DataFrame:
    """``docs`` of the weighted sources with ``arrival``; a source without weight, or weight 0, never arrives."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
    df = docs.withColumn("_weight", F.try_element_at(table, F.col(source))).filter("_weight > 0")
    df = df.withColumn("_gap", -F.log(uniform(F.lit(seed), F.col(source), F.col(position))) / F.col("_weight"))
    return running_sum(df, "_gap", "arrival", [position], [source]).drop("_weight", "_gap")


def running_sum(df: DataFrame, value: str, to: str, order: list[str], within: list[str] | None = None, exclusive: bool = False) -> DataFrame:
    """``df`` with the running sum of ``value`` along ``order``, in two levels.

    Rows are cut into blocks by quantiles of the first order column, which must be numeric, some ``BLOCK_ROWS`` rows each, however
    large the table; sums of blocks are summed up, one row per block, and rows only within their block.  No task holds a whole
    partition of ``within``.
    """
    within = within or []
    first = F.col(order[0]).cast("double")
    n = df.count()
    blocks = max(LEAST_BLOCKS, min(1 << 16, -(-n // BLOCK_ROWS)))
    cuts = df.agg(F.percentile_approx(first, [i / blocks for i in range(1, blocks)], 4 * max(blocks, 2500)).alias("q")).first()["q"] or []
    table = F.lit([float(x) for x in sorted(set(cuts))]).cast("array<double>")
    # the cuts are ascending, so the place of the first that is not below is found by halving them
    blocked = df.withColumn("_block", _place(table, first, len(set(cuts))))
    names = [f"_k_{c}" for c in within]
    ahead = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # named anew before they are grouped, so that the join meets no column of its other side
    parts = blocked.select(F.col("_block").alias("_b"), F.col(value).alias("_v"), *[F.col(c).alias(f"_k_{c}") for c in within])
    starts = parts.groupBy(*names, "_b").agg(F.sum("_v").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*within, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    summed = blocked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = summed.join(starts, (F.col("_block") == F.col("_b")) & _all_same(within))
    return out.withColumn(to, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_block", "_b", *[f"_k_{c}" for c in within])


def _place(table: Column, value: Column, n: int) -> Column:
    """How many of the ``n`` ascending numbers of ``table`` are below ``value``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(table, at + step - 1) < value, F.lit(False)), step).otherwise(F.lit(0)))


def _all_same(within: list[str]) -> Column:
    out = F.lit(True)
    for c in within:
        out = out & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return out


def within_budget(df: DataFrame, size: Column, budget: int | None, order: list[str], max_docs: int | None = None) -> DataFrame:
    """Rows along ``order`` while what came before is under the budget and the count under ``max_docs``: the row that crosses it stays."""
    df = running_sum(df.withColumn("_size", size.cast("long")).withColumn("_one", F.lit(1).cast("long")), "_size", "_before", order, exclusive=True)
    if budget is not None:
        df = df.filter(F.col("_before") < budget)
    if max_docs is not None:
        df = running_sum(df, "_one", "_nth", order).filter(F.col("_nth") <= max_docs).drop("_nth")
    return df.drop("_size", "_one", "_before")


def mixed_stream(docs: DataFrame, weights: dict[str, float], quality: bool = True, dedup: bool = True, min_chars: int = 50, max_chars: int | None = None, max_docs: int | None = None, seed: int = 42, source: str = "source", position: str = "doc_id", text: str = "text") -> DataFrame:
    """position, source, arrival of the documents that a weighted mix of sources yields.

    Sources interleave by weight; what is too short goes, then with ``quality`` what the quality rules reject, then with ``dedup`` what begins
    like a document that arrived before; the rest stays within the budgets.  Rejected documents cost a place in the
    interleave but no budget.  A null text goes.
    """
    good = good_text(F.col(text)) if quality else F.lit(True)
    # the gates read the texts once; what follows is narrow, and several passes read it
    d = saved(docs.select(position, source, F.length(text).alias("_n"), good.alias("_good"), prefix_key(F.col(text)).alias("_key_")))
    kept = arrivals(d, weights, source, position, seed).filter((F.col("_n") >= min_chars) & F.col("_good"))
    if dedup:
        kept = first_wins(kept, F.col("_key_"), ["arrival", source, position]).filter("is_first").drop("is_first")
    return within_budget(kept, F.col("_n"), max_chars, ["arrival", source, position], max_docs).select(position, source, "arrival")


def quota_sizes(max_docs: int, shares: dict[str, float]) -> dict[str, int]:
    return {k: max(1, int(max_docs * v)) for k, v in shares.items()}


def head_of_sources(docs: DataFrame, quotas: dict[str, int], source: str = "source", position: str = "doc_id") -> DataFrame:
    """The first so many rows of each source; a union of limits, each of which sorts no more than its quota."""
    out = None
    for name, n in quotas.items():
        part = docs.filter(F.col(source) == name).orderBy(position).limit(n)
        out = part if out is None else out.unionByName(part)
    return out


def in_proportion(sources: dict[str, DataFrame], shares: dict[str, float], max_docs: int, cut: int = 2000, seed: int = 42, position: str = "doc_id", text: str = "text") -> DataFrame:
    """source, position, place, text: of each source its share of ``max_docs``, at least one, the first by ``position``, cut at 2000 characters, all shuffled.

    The shuffle is an order by a hash of seed, source and position, so it is the same on every run and layout; ``place`` counts from 1 and ends at ``max_docs``.
    A quota is a place in its source, so texts are selected by it and not sorted: positions must be distinct and not null.
    """
    quotas, out = quota_sizes(max_docs, shares), None
    for name, n in quotas.items():
        if name in sources:
            part = first_rows(sources[name].select(position, F.substring(text, 1, cut).alias(text)), n, position).select(F.lit(name).alias("source"), position, text)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source has a share")
    # the cap bounds what is sorted; a hash that is even over its range makes blocks of equal size
    out = out.withColumn("_at", uniform(F.lit(seed), F.col("source"), F.col(position)))
    out = running_sum(out.withColumn("_one", F.lit(1).cast("long")), "_one", "place", ["_at", "source", position])
    return out.filter(F.col("place") <= max_docs).select("source", position, "place", text)


def first_rows(df: DataFrame, n: int, position: str = "doc_id") -> DataFrame:
    """The first ``n`` rows by a position that is distinct: its n-th value is found first, over that column alone, and rows are filtered by it."""
    last = df.select(position).filter(F.col(position).isNotNull()).orderBy(position).limit(n).agg(F.max(position)).first()[0]
    return df.filter(F.col(position) <= last) if last is not None else df.limit(0)


def filled_quota(candidates: DataFrame, quota: int, priority: dict[str, int], source: str = "source", position: str = "doc_id") -> DataFrame:
    """``quota`` rows, sources of lower rank only where those before fall short."""
    rank = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    return candidates.withColumn("_rank", F.try_element_at(rank, F.col(source))).filter("_rank is not null").orderBy("_rank", position).limit(quota).drop("_rank")


def chunks(docs: DataFrame, text: str = "text", size: int = 4000, least_doc: int = 300, more_than: int = 200, trim: bool = True) -> DataFrame:
    """Pieces of ``size`` characters of documents of at least ``least_doc``, those longer than ``more_than``: chunk_no, chunk."""
    t = strip(F.col(text)) if trim else F.col(text)
    docs = docs.withColumn("_t", t).filter(F.length("_t") >= least_doc)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / size).cast("int")), lambda i: F.substring(F.col("_t"), i * size + 1, F.lit(size)))
    return docs.select("*", F.posexplode(pieces).alias("chunk_no", "chunk")).drop("_t", text).filter(F.length("chunk") > more_than)


def shard_ids(df: DataFrame, lines: int = 5000, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard_id``: consecutive runs of ``lines`` rows along ``order``."""
    df = running_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", "_nth", order or ["doc_id"])
    return df.withColumn("shard_id", F.floor((F.col("_nth") - 1) / lines)).drop("_one", "_nth")


def after_share(df: DataFrame, size: str, share: float, order: list[str]) -> DataFrame:
    """``df`` with ``is_val``: whether the row's first token lies behind ``share`` of all tokens."""
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    df = running_sum(df, size, "_before", order, exclusive=True)
    return df.withColumn("is_val", F.col("_before") >= int(total * share)).drop("_before")
