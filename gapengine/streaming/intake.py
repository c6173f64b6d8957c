"""Incident intake as a stream: analyse, append, and keep the pattern table up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine import fixed
from gapengine.operators.patterns import Partials, merged, partials_of, patterns_from
from gapengine.operators.sizing import materialise


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """STR-1: each batch owns one partition, so a repeated batch replaces itself."""
    (
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )


def ranges_after(n: int) -> list[tuple[int, int]]:
    """Into which runs of batches the partials of the first ``n`` are merged: one for each binary digit of ``n``.

    A batch therefore takes part in a merge at most once for each doubling of the history."""
    out, start = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            out.append((start, start + (1 << bit)))
            start += 1 << bit
    return out


def _read(spark: SparkSession, path: str, runs: list[tuple[int, int]]) -> list[Partials]:
    return [Partials(*[spark.read.parquet(f"{path}/{name}/{a}-{b}") for name in Partials._fields]) for a, b in runs]


def merge_batch(obs: DataFrame, batch_id: int, path: str) -> Partials:
    """STR-2: add one batch's gaps to the stored partials; all partials there are then.

    Reads this batch and the runs it completes, never the history of gaps.  What
    is written depends on the batch number alone, so a repeated batch replaces
    itself.  Runs are added and replaced, none is changed in place."""
    spark = obs.sparkSession
    before, after = ranges_after(batch_id), ranges_after(batch_id + 1)
    new = after[-1]
    own = merged([partials_of(obs), *_read(spark, path, [r for r in before if r not in after])])
    for name, rows in own._asdict().items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/{new[0]}-{new[1]}")
    _remove(spark, path, set(ranges_after(batch_id - 1)) - set(before) if batch_id else set())
    return merged(_read(spark, path, after))


def _remove(spark: SparkSession, path: str, runs: set[tuple[int, int]]) -> None:
    """Runs that an earlier, finished batch has merged into a larger one."""
    for a, b in runs:
        for name in Partials._fields:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{a}-{b}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def current_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The pattern table as the latest batch left it."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(newest), "version").drop("version")  # one row


def start_intake(
    incidents: DataFrame, analyse: Callable[[DataFrame], DataFrame], observations_path: str, patterns_path: str,
    checkpoint: str, min_incidents: int = fixed.PATTERN_MIN_INCIDENTS, available_now: bool = True, partials_path: str | None = None,
):
    """STR-1/STR-2: run ``analyse`` on every micro-batch of the stream against a
    static index, append its gap observations, merge its partials (kept beside the
    patterns unless ``partials_path`` is given) and write a new version of the
    pattern table.  The observations written are read by later readers only."""
    partials_path = partials_path or f"{patterns_path}_partials"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        found = materialise(analyse(batch))
        append_batch(found, batch_id, observations_path)
        patterns = patterns_from(merge_batch(found, batch_id, partials_path), min_incidents)
        # A version of its own: readers of the one before are not disturbed.
        patterns.write.mode("overwrite").parquet(f"{patterns_path}/version={batch_id}")

    writer = incidents.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
