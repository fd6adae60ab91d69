"""Measures of corpora and logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import bound, ngrams, words

#: Parts of the range of hashes, as bits; hashes and rows that a task holds before it sends them.
PART_BITS, HELD, ROWS = 12, 1 << 22, 512


def _has_loop(grams: Column, more_than: int) -> Column:
    """Whether a window occurs more than so many times: then two equal ones stand so far apart when they are sorted."""

    def found(s: Column) -> Column:
        last = F.size(s) - more_than
        return (last >= 1) & F.exists(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.coalesce(F.get(s, i) == F.get(s, i + more_than), F.lit(False)))

    return bound(F.array_sort(grams), found)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct rows of two 64-bit hashes, sorted."""
    hashes = hashes[np.lexsort((hashes[:, 1], hashes[:, 0]))]
    return hashes[np.r_[True, (hashes[1:] != hashes[:-1]).any(1)]] if len(hashes) else hashes


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of a task (a, b arrays by row), by their part; up to ``HELD`` are held at a time."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes = _distinct(np.concatenate(held))
        part = (hashes[:, 0] >> np.uint64(64 - PART_BITS)).astype(np.int32)  # ascending, as the hashes are
        parts, at = np.unique(part, return_index=True)
        content = [hashes[i:j].tobytes() for i, j in zip(at, [*at[1:], len(part)][: len(at)], strict=True)]  # a task may have no hash
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(content, pa.binary())], names=["part", "hashes"])

    held, n = [np.empty((0, 2), np.uint64)], 0
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        held.append(np.stack([batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1)], 1))
        n += len(held[-1])
        if n >= HELD:
            yield sent(held)
            held, n = [held[0][:0]], 0
    yield sent(held)


def _counted(part: pa.Table) -> pa.Table:
    hashes = np.frombuffer(b"".join(part.column("hashes").to_pylist()), np.uint64).reshape(-1, 2)
    return pa.table({"n": pa.array([len(_distinct(hashes))], pa.int64())})


def diversity(docs: DataFrame, text: str = "text", more_than: int = 3) -> DataFrame:
    """One row: unique and total word trigrams (lower case), their ratio, documents with a trigram more than three times.

    Totals and loops are had within each document.  Only distinct trigrams meet, by 128 bits of hashes, combined before the exchange: a task
    sends each part of the hashes' range as one row of bytes, and a part, one of 4096, is counted in one group.
    """
    grams = docs.select(ngrams(words(F.lower(text))).alias("g"))
    total = grams.agg(F.coalesce(F.sum(F.size("g")), F.lit(0)).alias("total_trigrams"), F.count(F.when(_has_loop(F.col("g"), more_than), 1)).alias("loop_docs"))
    hashes = lambda *seed: F.transform("d", lambda t: F.xxhash64(t, *seed))
    distinct = grams.select(F.array_distinct("g").alias("d")).select(hashes().alias("a"), hashes(F.lit(1)).alias("b"))
    parts = distinct.mapInArrow(_parted, "part int, hashes binary").groupBy("part").applyInArrow(_counted, "n bigint")
    unique = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unique_trigrams"))
    out = unique.join(total)  # two tables of one row each
    return out.select((F.coalesce(F.try_divide("unique_trigrams", "total_trigrams"), F.lit(0.0))).alias("diversity"), "unique_trigrams", "total_trigrams", "loop_docs")


def loop_docs(docs: DataFrame, text: str = "text", more_than: int = 3, position: str = "doc_id") -> DataFrame:
    """Documents in which a trigram occurs more than three times; nothing is shuffled."""
    return docs.filter(_has_loop(ngrams(words(F.lower(text))), more_than)).select(position)


def perplexity(rows: DataFrame, loss: str = "loss", n: str = "n_tokens") -> DataFrame:
    """exp of the mean loss by tokens; infinite without tokens."""
    mean = F.sum(F.col(loss) * F.col(n)) / F.sum(n)
    return rows.agg(F.when(F.coalesce(F.sum(n), F.lit(0)) > 0, F.exp(mean)).otherwise(F.lit(float("inf"))).alias("perplexity"))


def compared(a: DataFrame, b: DataFrame, measures: list[str]) -> DataFrame:
    """measure, a, b, delta of two tables of one row."""
    long = lambda df, to: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(to)) for m in measures])).alias("x")).select("x.*")
    return long(a, "a").join(long(b, "b"), "measure").withColumn("delta", F.col("b") - F.col("a"))


def log_summary(log: DataFrame, group: str = "log", position: str = "pos", window: int = 10) -> DataFrame:
    """By log: entries, last step and loss; with more than ten, mean loss of the first and last ten that have one, and the drop."""
    n = F.count("*").over(Window.partitionBy(group))
    up = F.row_number().over(Window.partitionBy(group).orderBy(position))
    rows = log.withColumn("_n", n).withColumn("_up", up)
    edge = (F.col("_n") > window) & F.col("loss").isNotNull()
    out = rows.groupBy(group).agg(
        F.count("*").alias("entries"),
        F.max_by("step", position).alias("last_step"),
        F.max_by("loss", position).alias("last_loss"),
        F.avg(F.when(edge & (F.col("_up") <= window), F.col("loss"))).alias("early_loss"),
        F.avg(F.when(edge & (F.col("_up") > F.col("_n") - window), F.col("loss"))).alias("recent_loss"),
    )
    return out.withColumn("drop", F.col("early_loss") - F.col("recent_loss"))


def interval_means(log: DataFrame, every: int, step: str = "step", loss: str = "loss") -> DataFrame:
    """Mean loss of each run of ``every`` steps."""
    return log.groupBy(F.floor(F.col(step) / every).alias("interval")).agg(F.avg(loss).alias("mean_loss"), F.max(step).alias("last_step"))


def epoch_means(log: DataFrame, every: int = 10, epoch: str = "epoch", step: str = "step", loss: str = "loss") -> DataFrame:
    """Mean loss since the epoch's start, at every tenth step of it."""
    w = Window.partitionBy(epoch).orderBy(step)
    rows = log.withColumn("mean_loss", F.avg(loss).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(w))
    return rows.filter(F.col("nth") % every == 0).select(epoch, step, "mean_loss")


def learning_rate(step: Column, warmup: int, steps: int, high: float, low: float) -> Column:
    """Linear warm-up, cosine to ``low``, then ``low``."""
    cosine = low + 0.5 * (high - low) * (1 + F.cos(F.pi() * (step - warmup) / (steps - warmup)))
    return F.when(step < warmup, high * (step + 1) / warmup).when(step >= steps, low).otherwise(cosine)


def parameters(vocab: Column, d: Column, layers: Column, heads: Column, kv_heads: Column, ff: Column) -> Column:
    """Weights of a decoder with grouped attention and a gated feed-forward layer, by its shape."""
    return vocab * d + layers * ((heads + 2 * kv_heads) * F.floor(d / heads) * d + d * d) + layers * 3 * d * ff


def last(df: DataFrame, n: int, position: str) -> DataFrame:
    return df.orderBy(F.desc(position)).limit(n)


def file_inventory(files: DataFrame) -> DataFrame:
    """By directory: files and bytes, of a ``binaryFile`` table whose content is not read."""
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), "length").groupBy("directory").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
