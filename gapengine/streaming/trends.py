"""Gaps per family and stretch of event time, as a stream with late rows dropped by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine.streaming.intake import append_batch


def family_trend(stream: DataFrame, time: str = "ts", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """STR-3: gaps and distinct kinds of gap per family and window of event time.

    A row is dropped when its whole window lies more than ``delay`` before the
    newest row known one batch earlier (Spark judges late rows by the watermark
    of the batch before); until then it still changes its window.
    Counts combine map-side, so a frequent family is no hot spot.
    """
    return (
        stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, width).alias("window"), "family_key")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("coverage") == "NOT_COVERED", 1)).alias("n_uncovered"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "family_key", "n", "n_uncovered")
    )


def start_trend(stream: DataFrame, path: str, checkpoint: str, time: str = "ts", width: str = "1 day", delay: str = "1 day", available_now: bool = True):
    """STR-3: append every window that a batch changed, under the batch's number."""
    writer = family_trend(stream, time, width, delay).writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: append_batch(batch, batch_id, path)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_trend(spark: SparkSession, path: str) -> DataFrame:
    """Each window as the latest batch that changed it left it."""
    rest = F.struct("end", "n", "n_uncovered")
    newest = spark.read.parquet(path).groupBy("start", "family_key").agg(F.max_by(rest, "batch_id").alias("last"))
    return newest.select("start", "last.end", "family_key", "last.n", "last.n_uncovered")
