"""Incremental processing: resumable batches and their streaming forms.

Finished rows are appended to a results table and skipped on the next run.  As a stream the same happens per
micro-batch, with a checkpoint for the position and an idempotent write per batch number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefengine.functions.text import clean_text, squeezed
from prefengine.operators.external import latest, pending


def resume(rows: DataFrame, results: DataFrame | None, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Existing and new results, last wins; only pending rows are worked on."""
    if results is None:
        return work(rows)
    fresh = work(pending(rows, results, key))
    return results.unionByName(fresh, allowMissingColumns=True)


def deduplicated_stream(stream: DataFrame, text: str, at: str, delay: str) -> DataFrame:
    """A cleaned stream in which a text seen within the watermark does not come again."""
    return (stream.withColumn("cleaned", clean_text(F.col(text))).withColumn("norm", squeezed(F.col("cleaned")))
            .withWatermark(at, delay).dropDuplicatesWithinWatermark(["norm"]))


def windowed_metrics(events: DataFrame, at: str, kind: str, value: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """(start, end, kind, n, total, lowest, highest) in tumbling or sliding windows; late rows within the delay count."""
    return (events.withWatermark(at, delay).groupBy(F.window(at, width, slide), kind)
            .agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "total", "lowest", "highest"))


def sessions(events: DataFrame, at: str, user: str, gap: str, delay: str) -> DataFrame:
    """(user, start, end, n) of each user's sessions."""
    return (events.withWatermark(at, delay).groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n"))
            .select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"))


def write_once(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each micro-batch goes to its own partition, which a repeated batch overwrites."""
    def save(batch: DataFrame, number: int) -> None:
        work(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, key: str, order: Column | None = None) -> DataFrame:
    """What ``write_once`` wrote, the last batch of each key winning."""
    return latest(spark.read.parquet(path), key, "batch")
