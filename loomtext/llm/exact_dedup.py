"""Exact de-duplication by progressive refinement, in DataFrame operations only.

Rows are first told apart by the length of their normalised text, then, where a length repeats, by a hash of
its first characters, and only where that repeats too by a SHA-256 of all of it.  What survives a level is
passed on as a bitmap of fixed size (``2 ** FILTER_BITS`` bits, one megabyte), so no level shuffles a text and a
row outside the bitmap is never hashed in full; a false positive of the bitmap only costs that row a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import settled, without_spaces

#: Bits of the bitmap that carries the surviving keys of a level: 2 ** 23 bits are 256 rows of 4 KiB.
FILTER_BITS = 23
_PAGE = 32768  # bits in one row of bitmap_construct_agg


def _slot(key: Column, size: int = FILTER_BITS) -> Column:
    return F.pmod(key, F.lit(1 << size))


def _bitmap(keys: DataFrame, key: str, page: str, bits: str, size: int = FILTER_BITS) -> DataFrame:
    """The slots of the column ``key`` as rows of 4 KiB, 2 ** ``size`` bits at most."""
    slot = _slot(F.col(key), size)
    return keys.groupBy(F.floor(slot / _PAGE).alias(page)).agg(F.bitmap_construct_agg(slot % _PAGE).alias(bits))


def _marked(df: DataFrame, key: str, bitmap: DataFrame, page: str, bits: str, flag: str, size: int = FILTER_BITS) -> DataFrame:
    """``df`` with the boolean ``flag``: whether the slot of ``key`` is set. The bitmap has a fixed size, so it is broadcast."""
    slot = _slot(F.col(key), size)
    at = (slot % _PAGE).cast("int")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(pmod({key}, {1 << size}) % {_PAGE} div 8 as int) + 1, 1)")), 16, 10).cast("bigint")
    return (
        df.withColumn(page, F.floor(slot / _PAGE))
        .join(F.broadcast(bitmap), page, "left")
        .withColumn(flag, F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)))
        .drop(page, bits)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, and ``content_key``.

    Texts are equal when identical after deleting space and U+0009 to U+000D.  Of equal texts the row with
    the most code points in the original stays, then the smallest id (a null id counts as smallest).

    * null text: as the empty text; all empty texts are one group.
    * rows that repeat an id and a text: each is returned, and all of them are kept if that id stays.
    * empty table: no rows.  Other columns are ignored, whatever their names.
    * ``digest``: also return ``text_sha256`` of the normalised text, which reads every text in full.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("_points"), without_spaces(text).alias("_norm"))
    rows = rows.withColumn("_len", F.length("_norm").cast("long"))

    lengths = rows.groupBy("_len").count().filter("count > 1")
    rows = _marked(rows, "_len", _bitmap(lengths, "_len", "_page1", "_bits1"), "_page1", "_bits1", "_same_len")

    rows = rows.withColumn("_prefix", F.when(F.col("_same_len"), F.xxhash64("_len", F.substring("_norm", 1, prefix_chars))))
    prefixes = rows.filter("_same_len").groupBy("_prefix").count().filter("count > 1")
    rows = _marked(rows, "_prefix", _bitmap(prefixes, "_prefix", "_page2", "_bits2"), "_page2", "_bits2", "_same_prefix")

    # What one of the two filters let go is alone with its length or with its prefix, and that names its group.
    full = F.sha2("_norm", 256)
    alone = F.concat_ws("/", F.lit("alone"), "_len", "_prefix")
    rows = rows.select("doc_id", "_points", F.when(F.col("_same_prefix"), full).otherwise(alone).alias("content_key"), *([full.alias("text_sha256")] if digest else []))
    rows = settled(rows)

    best = F.min(F.struct((-F.col("_points")).alias("less"), F.col("doc_id").alias("id")))
    # saved, so that both sides of the join come by an exchange of their own and a group of very many copies can be split
    groups = settled(rows.groupBy("content_key").agg(best.alias("_best"), F.count("*").alias("_n")).filter("_n > 1"))
    alone = F.col("_n").isNull()
    kept = alone | F.col("doc_id").eqNullSafe(F.col("_best.id")) & (F.col("_points") == -F.col("_best.less"))
    out = rows.join(groups, "content_key", "left")
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("_best.id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("_n", F.lit(1)).alias("group_size"), kept.alias("kept"), *(["text_sha256"] if digest else []), "content_key")
