"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.functions import normalize
from loomtext.functions.text import alpha_share
from loomtext.operators.dedup import content_key
from loomtext.sources.writers import notable


def documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, source string", fmt: str = "json", **options: str) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def cleaned(stream: DataFrame, min_chars: int = 200, min_alpha: float = 0.4, event_time: str | None = None, lateness: str = "1 hour", unicode: bool = True) -> DataFrame:
    """Cleaned documents, each content once.

    With an event time, keys are forgotten after ``lateness``, which bounds the state; without, all keys are kept, as a stream without
    times can promise nothing else.  The first to arrive wins.
    """
    t = stream.withColumn("text", normalize.clean(F.col("text"), unicode)).filter(F.length("text") >= min_chars).withColumn("_key", content_key(F.col("text")))
    if event_time:
        t = t.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["_key"])
    else:
        t = t.dropDuplicates(["_key"])
    return t.filter(alpha_share(F.col("text")) >= min_alpha).drop("_key").withColumn("chars", F.length("text"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now, then stop; the next call goes on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_source(stream: DataFrame, event_time: str, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Documents and characters by source and window of event time."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), "source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


def delivered(batch: DataFrame, batch_id: int, path: str, sinks: dict[str, int], event: str = "event") -> None:
    """The batch's events into ``path/sink=.../batch_id=...``, for each sink those that reach its least importance.

    A batch that comes again after a failure leaves no second row in any sink: the writer's ``_SUCCESS`` in the batch's folder is the record that it has
    been delivered there, and a folder without it is replaced whole.
    """
    jvm, conf = batch.sparkSession._jvm, batch.sparkSession._jsc.hadoopConfiguration()
    for name, least in sinks.items():
        at = f"{path}/sink={name}/batch_id={batch_id}"
        record = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not record.getFileSystem(conf).exists(record):
            notable(batch, least, event).write.mode("overwrite").json(at)


def notify(stream: DataFrame, path: str, checkpoint: str, sinks: dict[str, int] | None = None) -> StreamingQuery:
    """Notable events to each sink, exactly once: batches keep their ids over restarts from ``checkpoint``."""
    to = sinks or {"log": 2}
    return stream.writeStream.foreachBatch(lambda batch, n: delivered(batch, n, path, to)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
