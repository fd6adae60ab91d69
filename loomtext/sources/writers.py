"""Sinks.  A table that is being read is never overwritten: new data goes to a staging path that takes the old one's place."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.config import IMPORTANCE
from loomtext.operators.mix import shard_ids
from loomtext.operators.tokens import packed, stats, vocabulary


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def _moved(fs, source, to) -> None:
    if not fs.rename(source, to):
        raise OSError(f"could not move {source} to {to}")


def replaced(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write ``df``, which may read ``path``, then move it to ``path``; the old data stays at ``path.bak``.

    The backup of the time before goes last, when the new data is in place; if that cannot be moved there, the old data comes back and
    this raises.
    """
    target, staged, backup, old = (spark._jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".staged", ".bak", ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").json(path + ".staged")
    had = fs.exists(target)
    if had:
        fs.delete(old, True)
        _moved(fs, target, old)
    try:
        _moved(fs, staged, target)
    except OSError:
        if had:
            _moved(fs, old, target)
        raise
    if had:
        fs.delete(backup, True)
        _moved(fs, old, backup)


def sharded(df: DataFrame, path: str, lines: int = 5000, order: list[str] | None = None) -> None:
    """One directory ``shard_id=n`` for each run of ``lines`` rows; no empty last shard."""
    numbered = shard_ids(df, lines, order)
    numbered.repartition("shard_id").write.partitionBy("shard_id").mode("errorifexists").json(path)


def tokens(docs: DataFrame, path: str, vocab_size: int) -> DataFrame:
    """Encoded documents as parquet (32-bit ids); returns the corpus's statistics."""
    docs.write.mode("errorifexists").parquet(path)
    return stats(docs.sparkSession.read.parquet(path)).withColumn("vocab_size", F.lit(vocab_size))


def sequences(docs: DataFrame, path: str, seq_len: int, ids: str = "ids", position: str = "doc_id", mode: str = "errorifexists") -> None:
    """Packed sequences of ``seq_len + 1`` ids as JSON lines (seq_id, ids); the last id of one is the first of the next, what is left over is dropped."""
    packed(docs, seq_len, overlap=True, ids=ids, position=position).write.mode(mode).json(path)


def tokenizer(spark: SparkSession, path: str, merges: list[tuple[int, int]]) -> None:
    """Merges and readable vocabulary as one JSON file in any store that Spark reaches; it has the size of a vocabulary."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    text = json.dumps({"merges": merges, "vocab": {i: b.decode("utf-8", "replace") for i, b in vocabulary(merges).items()}}, ensure_ascii=False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def cached_map(spark: SparkSession, build, path: str, our_size: int, their_size: int) -> DataFrame:
    """A vocabulary map kept under both vocabularies' sizes; built where it is missing."""
    at = f"{path}/ours={our_size}/theirs={their_size}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(at + "/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def longest_versions(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """Of conversations saved again and again as they grow, the longest: a row goes if its messages begin another's; of equal ones one stays.

    Each row names its beginnings by a chained hash, so conversations meet by equality and a common opening alone joins nothing.
    """
    chain = F.aggregate(messages, F.array().cast("array<string>"), lambda acc, m: F.concat(acc, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.to_json(F.array(m))).cast("binary")))))
    keyed = rows.select(messages, F.when(F.size(messages) > 0, chain).otherwise(F.array().cast("array<string>")).alias("_chain"))
    keyed = keyed.withColumn("_key", F.coalesce(F.try_element_at("_chain", F.lit(-1)), F.lit("")))
    begun = keyed.select(F.explode(F.slice("_chain", F.lit(1), F.greatest(F.size("_chain") - 1, F.lit(0)))).alias("_key")).distinct()
    return keyed.join(begun, "_key", "left_anti").filter(F.size(messages) > 0).dropDuplicates(["_key"]).select(messages)


def importance(event: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, event), F.lit(1))


def notable(events: DataFrame, least: int = 1, event: str = "event") -> DataFrame:
    """Events at or above an importance."""
    return events.filter(importance(F.col(event)) >= least)


def routed(events: DataFrame, sinks: dict[str, int], event: str = "event") -> DataFrame:
    """One row per event and sink whose least importance it reaches: the column ``sink``."""
    wanted = F.filter(F.array(*[F.when(importance(F.col(event)) >= least, F.lit(name)) for name, least in sinks.items()]), lambda x: x.isNotNull())
    return events.withColumn("sink", F.explode(wanted))
