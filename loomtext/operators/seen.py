"""Keys that earlier runs have seen: an index on disk in buckets, with a Bloom filter for each, that runs ask and add to."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import normalize
from loomtext.functions.text import alpha_share
from loomtext.operators.dedup import content_key
from loomtext.session import saved
from loomtext.sources.writers import replaced

#: Bits of a piece of a filter, as ``bitmap_construct_agg`` makes them.
PIECE = 32_768


class SeenIndex:
    """Binary keys under ``path``: ``keys/run=r/bucket=b``, ``filters/run=r`` and a record ``runs/r`` for each run that is published.

    A run is published by one rename of its record, after its keys and filters are written, so readers see all of it or nothing; what a failed run left behind is in no
    record and is never read.  Publishing a run's name a second time changes nothing, so a run that is repeated after its record was written asks only
    the runs before it and gives the same answer.  One writer at a time.

    ``buckets`` and ``pieces`` (of 4 kB, a filter's size in each run and bucket) are fixed by the first run.  At 8 bits and more a key, two probes let some 5 % of new keys read a
    bucket; beyond, filters fill up and runs read more, but no answer changes.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, pieces: int = 64):
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.buckets, self.pieces = buckets, pieces
        for record in self._records()[:1]:
            self.buckets, self.pieces = record["buckets"], record["pieces"]
        self.asked: list[int] = []

    # the records: small files of a line, one a run
    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def _records(self) -> list[dict]:
        try:
            lines = self.spark.read.text(f"{self.path}/runs").collect()  # one a run
        except AnalysisException:
            return []
        return sorted((json.loads(r["value"]) for r in lines), key=lambda r: r["order"])

    def runs(self, before: str | None = None) -> list[str]:
        """Published runs in their order, those before ``before`` if it is one of them."""
        names = [r["run"] for r in self._records()]
        return names[: names.index(before)] if before in names else names

    def _probed(self, keys: DataFrame, key: str) -> DataFrame:
        """bucket and two places in its filter for each key."""
        place = lambda seed: F.pmod(F.xxhash64(F.lit(seed), key), F.lit(self.pieces * PIECE))
        return keys.withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), key), F.lit(self.buckets)).cast("int")).withColumn("_probes", F.array(place(1), place(2)))

    def _read(self, what: str, runs: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{what}").schema("key binary, run string, bucket int" if what == "keys" else "bucket int, piece bigint, bits binary, run string").parquet(*[f"{self.path}/{what}/run={r}" for r in runs])

    def known(self, keys: DataFrame, key: str = "key", before: str | None = None) -> DataFrame:
        """The distinct ones of ``keys`` that a published run holds.

        Keys meet the filters first.  Only keys that a filter lets through go on, and only the buckets that such keys have are opened, by partition pruning; ``asked`` has
        their numbers afterwards.  Filters are joined by (bucket, piece), not broadcast.
        """
        new = keys.select(F.col(key).alias("key")).filter("key is not null").distinct()
        runs = self.runs(before)
        self.asked = []
        if not runs:
            return new.limit(0)
        probed = self._probed(new, "key").select("key", "bucket", F.posexplode("_probes").alias("probe", "place"))
        probed = probed.withColumn("piece", F.floor(F.col("place") / PIECE)).withColumn("_bit", F.col("place") % PIECE)
        filters = self._read("filters", runs)
        byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = probed.join(filters, ["bucket", "piece"]).filter(F.getbit(byte.cast("long"), (F.col("_bit") % 8).cast("int")) == 1)
        passed = saved(hit.groupBy("key", "bucket", "run").agg(F.countDistinct("probe").alias("n")).filter("n = 2").select("key", "bucket").distinct())
        self.asked = sorted(r["bucket"] for r in passed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not self.asked:
            return new.limit(0)
        held = self._read("keys", runs).filter(F.col("bucket").isin(self.asked)).select("key", "bucket")
        return passed.join(held, ["key", "bucket"], "left_semi").select("key")

    def publish(self, keys: DataFrame, run: str, key: str = "key") -> None:
        """Add a run's distinct keys.  ``run`` is its name: letters, digits, ``-`` and ``_``."""
        if not run or not all(c.isalnum() or c in "-_" for c in run):
            raise ValueError(f"no name of a run: {run!r}")
        records = self._records()
        if run in [r["run"] for r in records]:
            return
        new = self._probed(keys.select(F.col(key).alias("key")).filter("key is not null").distinct(), "key")
        new.select("key", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/run={run}")
        # the filters are of what was written, whatever a second computation of ``keys`` would give
        written = self._probed(self._read("keys", [run]).select("key"), "key").select("bucket", F.explode("_probes").alias("place"))
        bits = written.groupBy("bucket", F.floor(F.col("place") / PIECE).alias("piece")).agg(F.bitmap_construct_agg(F.col("place") % PIECE).alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.path}/filters/run={run}")
        staged, fs = self._at(f"{self.path}/_{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray((json.dumps({"order": len(records), "run": run, "buckets": self.buckets, "pieces": self.pieces}) + "\n").encode()))
        out.close()
        fs.mkdirs(self._at(f"{self.path}/runs")[0])
        if not fs.rename(staged, self._at(f"{self.path}/runs/{run}")[0]):
            raise OSError(f"could not publish {run}")


def first_seen(docs: DataFrame, index: SeenIndex, run: str, key: Column, position: str | list[str]) -> DataFrame:
    """``docs`` with ``is_first``: first of its key in this run, by ``position``, and in no run before; then the run's keys are published.

    Keys and positions alone are shuffled for the decision; rows that tie in all positions are all first, as in ``dedup.first_wins``.  A null key is seen by nobody
    and always first.
    """
    at = F.struct(*([position] if isinstance(position, str) else position))
    keyed = docs.withColumn("_key", key).withColumn("_at", at)
    first = saved(keyed.filter("_key is not null").groupBy("_key").agg(F.min("_at").alias("_first")))
    old = index.known(first, "_key", before=run).withColumn("_old", F.lit(True))
    verdict = saved(first.join(old.withColumnRenamed("key", "_key"), "_key", "left").filter("_old is null").select(F.col("_key").alias("_k"), "_first"))
    index.publish(first, run, "_key")
    won = F.col("_key").isNull() | F.coalesce(F.col("_at") == F.col("_first"), F.lit(False))
    return keyed.join(verdict, F.col("_key") == F.col("_k"), "left").withColumn("is_first", won).drop("_key", "_at", "_k", "_first")


def gated(docs: DataFrame, index: SeenIndex, run: str, position: str | list[str] = "doc_id", text: str = "text", min_chars: int = 200, min_alpha: float = 0.4) -> DataFrame:
    """``docs`` with ``gate`` (short, dup, bad or kept), where dup looks at this run and at all runs of ``index`` before it.

    As in one pass over all runs, a long enough text takes its key before its letters are counted.  Null texts are short.
    """
    short = F.coalesce(F.length(text) < min_chars, F.lit(True))
    asked = docs.withColumn("_short", short).withColumn("_fine", alpha_share(F.col(text)) >= min_alpha)
    tried = first_seen(asked, index, run, F.when(~short, content_key(F.col(text))).cast("binary"), position)
    gate = F.when(F.col("_short"), "short").when(~F.col("is_first"), "dup").when(~F.col("_fine"), "bad").otherwise("kept")
    return tried.withColumn("gate", gate).drop("is_first", "_short", "_fine")


def cleaned_in_place(spark: SparkSession, paths: list[str], index: SeenIndex, schema: str = "text string, source string", unicode: bool = True, **limits: float) -> None:
    """Clean folders of JSON lines where they are, each content kept once over all of them: the first folder, file and line wins.

    Each folder is a run of ``index`` and is swapped as ``writers.replaced`` does, with the old lines at ``.bak``.  A call that failed is made again: a folder whose
    keys were published but which was not swapped asks only the folders before it.  Lines that are no JSON objects go.
    """
    for n, path in enumerate(paths):
        lines = spark.read.schema(schema).json(path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_line"))
        lines = saved(lines.withColumn("text", normalize.clean(F.col("text"), unicode)))
        kept = gated(lines, index, f"{n:06d}", "_line", **limits).filter("gate = 'kept'").drop("gate", "_line").withColumn("chars", F.length("text"))
        replaced(spark, kept, path)
