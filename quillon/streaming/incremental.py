"""Incremental statistics over streams: mergeable histograms, deduplicated windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.metrics import auroc_from, histogram
from quillon.sources.delta import DeltaLog


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events as a stream; the event time is a timestamp, as watermarks ask."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, *, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """Counts and sums by event type and window; repeats within the watermark count once, later rows are dropped."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    once = events.withWatermark("ts", late)
    once = once.dropDuplicatesWithinWatermark([key]) if events.isStreaming else once.dropDuplicates([key])
    sums = once.groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def merge_histogram(state: DataFrame | None, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Add a batch of scores to the stored (keys, score, pos, neg)."""
    fresh = histogram(batch, keys)
    both = fresh if state is None else state.unionByName(fresh)
    return both.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _log(spark: SparkSession, state_path: str, keys: list[str]) -> DeltaLog:
    return DeltaLog(spark, state_path, lambda df: df.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def incremental_leaderboard(scores: DataFrame, state_path: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Keep the score histogram of a stream; a batch that is delivered again changes nothing.

    Each batch writes its own histogram to a log (``sources/delta.py``), whatever
    came before it.
    """
    keys = keys or ["signal"]
    log = _log(scores.sparkSession, state_path, keys)
    return scores.writeStream.foreachBatch(lambda batch, number: log.append(histogram(batch, keys), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leaderboard(spark: SparkSession, state_path: str, keys: list[str] | None = None) -> DataFrame:
    """AUROC of what the stream has delivered so far; a log that cannot be read raises."""
    keys = keys or ["signal"]
    stored = _log(spark, state_path, keys).read()
    if stored is None:
        raise ValueError(f"no state at {state_path}")
    return auroc_from(stored, keys)
