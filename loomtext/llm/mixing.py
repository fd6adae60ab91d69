"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``target / source_size`` times.  The documents of a source stand in a
fixed order, the expected copies are summed up along it, one offset per source is added, and a document is
emitted once for each whole number that its interval crosses.  The order goes by size class, so what a source
gives comes near its target also when sizes differ widely.

The prefix sum has two levels.  Documents are dealt to blocks (source, size class, hash of the id); the
blocks' counts are summed up per source, and only within a block are rows ranked.  A source that holds a third
of all rows is thus spread over its blocks, and no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import WORD, settled

#: Weights of the sources in order of their names, repeated as needed.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST = 3
#: Rows that a block holds on average at most, as the number of blocks grows with the table.
BLOCK_ROWS = 1 << 20
LEAST_BLOCKS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For rows (source, size): source, source_size, target.

    With weights by the order of names (code points, null last), all sizes are shared; a target stops at
    ``most`` times its source's size and the excess is shared again by weight until no target is above.  That
    ends in ``min(most * size, weight * level)`` with one level for all, found here by sorting the sources by
    the level at which they fill up.  The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_weight", weight)
    t = t.withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_fill", F.col("_cap") / F.col("_weight"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    t = t.withColumn("_level", level)
    final = F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(every)
    return t.withColumn("_final", final).select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_weight"), F.col("_cap"))).alias("target"))


def size_class(size: Column) -> Column:
    """Eight classes for each doubling of the size, from whole-number operations alone."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).bitwiseAND(F.lit(7)).cast("int")).cast("int")


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of ``docs``.

    * null text: size 0.  A source whose documents have no words: target 0, no copies.
    * null source: a source of its own, last in order.
    * rows that repeat an id: ranked one after the other; together they get what their rows are due.
    * empty table: no rows.  Other columns are ignored, whatever their names.
    The result depends on rows and ``seed`` only: reruns agree.
    """
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))
    blocks = max(LEAST_BLOCKS, 1 << (rows.count() // BLOCK_ROWS).bit_length())
    rows = rows.withColumn("_class", size_class(F.col("size"))).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int"))

    key = ["source", "_class", "_block"]
    ahead = Window.partitionBy("source").orderBy("_class", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    due = targets(rows, weights, most).withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    due = due.withColumn("_offset", offset)
    starts = starts.alias("s").join(due.alias("d"), F.col("s.source").eqNullSafe(F.col("d.source"))).select("s.source", "_class", "_block", "_start", "source_size", "target", "_rate", "_offset")

    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id")))
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._class") == F.col("s._class")) & (F.col("r._block") == F.col("s._block"))
    at = F.col("_start") + F.col("_rank")
    crossed = F.floor(at * F.col("_rate") + F.col("_offset")) - F.floor((at - 1) * F.col("_rate") + F.col("_offset"))
    return ranked.alias("r").join(starts.alias("s"), same).select("doc_id", "r.source", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``sampled`` gives it: the table mixed to its targets.

    Rows that repeat an id are dealt the copies of that id evenly, the first by text getting one more where it must be.
    """
    own = docs.columns
    copies = sampled(docs, id_col, **options).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    copies = settled(copies.filter("copies > 0").select(F.col("doc_id").alias("of"), "copies", "rows"))
    # the table's own columns stand aside, as names may clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    once = rows.join(copies.filter("rows = 1"), same)
    again = rows.join(copies.filter("rows > 1"), same)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.col("row").getField(c) for c, kind in docs.dtypes if not kind.startswith("map")]))
    share = F.floor(F.col("copies") / F.col("rows")) + (place <= F.col("copies") % F.col("rows")).cast("long")
    out = once.unionByName(again.withColumn("copies", share).filter("copies > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row").getField(c).alias(c) for c in own])
