"""Sharding by extendible hashing, in DataFrame operations only.

A document's key is hashed once.  The directory is indexed by the first bits of the hash; a bucket whose bytes
exceed the limit is split on the next bit, all others stay as they are.  Sums for all prefixes of a chunk of
``CHUNK`` bits come from one aggregate, so the directory takes one pass over (hash, bytes) for every 12 bits of
depth instead of one for every bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import settled

#: Bits of the hash that can be used; those of a decimal id's MD5, from the left.
BITS = 60
#: Bits by which the directory grows in one pass.
CHUNK = 12
#: Bytes that a shard holds at most.
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Leaves for rows (hash, bytes): depth, prefix, shard_bytes, shard_docs.

    A leaf is the shortest prefix whose bytes fit the limit, or that a single row has.  Rows of one hash cannot be parted; a
    prefix of all 60 bits is a leaf at any size.
    """
    leaves, depth, rest = None, 0, rows.select("hash", "bytes")
    while True:
        to = min(depth + CHUNK, BITS)
        fine = rest.groupBy(F.shiftright("hash", BITS - to).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        levels = F.sequence(F.lit(depth if depth == 0 else depth + 1), F.lit(to))
        sums = fine.withColumn("depth", F.explode(levels)).groupBy("depth", F.expr(f"shiftright(p, {to} - depth)").alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS) | (F.col("shard_docs") == 1)
        sums = settled(sums.withColumn("fits", fits))
        above = sums.filter("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        found = sums.filter("fits").withColumn("up", F.shiftright("prefix", 1))
        # the first level of a pass hangs below a prefix that the pass before found too large
        first = depth if depth == 0 else depth + 1
        found = found.filter(F.col("depth") == first).drop("up").unionByName(found.filter(F.col("depth") > first).join(above, ["depth", "up"], "left_semi").drop("up"))
        leaves = found if leaves is None else leaves.unionByName(found)
        large = sums.filter((F.col("depth") == to) & ~F.col("fits")).select(F.col("prefix").alias("_large"))
        if to == BITS or large.isEmpty():
            return leaves.drop("fits")
        rest = rest.join(large, F.shiftright("hash", BITS - to) == F.col("_large"), "left_semi")
        depth = to


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes, shard (its prefix, as bits), shard_bytes, shard_docs, fits.

    * null text: 0 bytes.  A null id is hashed as the empty text.
    * a text above the limit: alone in its shard, ``fits`` false.
    * rows that repeat an id share a hash and stay together; ``fits`` is false if they exceed the limit.
    * empty table: no rows.  Other columns are ignored, whatever their names.
    """
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), key_hash(F.col(id_col)).alias("hash")))
    leaves = settled(directory(rows, limit))
    # the depths at which leaves stand: at most BITS + 1 numbers
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    bits = F.when(F.col("depth") > 0, F.expr("right(lpad(bin(prefix), 64, '0'), depth)")).otherwise(F.lit(""))
    named = leaves.select("depth", "prefix", bits.alias("shard"), "shard_bytes", "shard_docs", (F.col("shard_bytes") <= limit).alias("fits"))
    # each row has one leaf: of its prefixes, at the depths there are, just one is a leaf's
    tried = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("hash", BITS - d).alias("prefix")) for d in depths])) if depths else F.lit(None)
    keyed = rows.withColumn("_p", tried).select("doc_id", "bytes", F.col("_p.depth").alias("depth"), F.col("_p.prefix").alias("prefix")) if depths else rows.select("doc_id", "bytes", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    return keyed.join(named, ["depth", "prefix"]).select("doc_id", "bytes", "shard", "shard_bytes", "shard_docs", "fits")
