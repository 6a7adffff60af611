"""The daily pipeline as a stream: new pages become records and postings, once each.

The file source and the checkpoint remember what has been read; each micro-batch is written under its own number, so
a batch that is run again after a loss replaces what it wrote and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import records_of
from ..operators.postings import build_postings, indexed_text
from ..operators.sizes import bounded_broadcast

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema, form: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def first_urls(articles: DataFrame, time: str = "loaded_at", delay: str = "7 days") -> DataFrame:
    """Each url once within the watermark: the bounded counterpart of the set of known urls."""
    return articles.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def _once(spark: SparkSession, batch: DataFrame, out: str, number: int) -> DataFrame:
    """The batch's new urls: not among those of earlier batches, each once, with its smallest doc_id."""
    row = F.struct(*[F.col(c) for c in batch.columns])
    fresh = batch.where("url is not null").groupBy("url").agg(F.min_by(row, "doc_id").alias("row")).select("row.*")
    if number > 0:
        known = spark.read.option("basePath", f"{out}/records").schema("url string, batch long").parquet(f"{out}/records").where(F.col("batch") < number)
        # of the known urls only those of the batch leave the scan; the set itself is never shuffled
        met = known.select("url").join(bounded_broadcast(fresh.select("url")), "url", "left_semi")
        fresh = fresh.join(met, "url", "left_anti")
    return fresh


def ingest(articles: DataFrame, out: str, checkpoint: str, stopping: bool = True, available_now: bool = True, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts the stream that writes ``records`` and ``postings`` below ``out``, partitioned by batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = _once(spark, batch, out, number).persist()
        try:
            records_of(fresh).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
            texts = fresh.select("doc_id", indexed_text(F.col("title"), F.col("content")).alias("text"))
            build_postings(texts, stopping).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
            if each:
                each(fresh, number)
        finally:
            fresh.unpersist()

    writer = articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of events per window; late events count until the watermark has passed."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.withWatermark("ts", delay).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, n): runs of a user's events without a longer gap."""
    sessions = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
