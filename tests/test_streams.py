"""Streams: patterns from partials, running recurrence, trends; each against brute force, restarts and late rows included."""

import os

import pytest
from pyspark.sql import functions as F

from gapengine.operators import history as hist, patterns as pat
from gapengine.streaming.intake import current_patterns, merge_batch, ranges_after, start_intake
from gapengine.streaming.recurrence import recurrence_so_far, start_recurrence
from gapengine.streaming.trends import current_trend, start_trend

OBS = "incident_id string, gap_type string, family_key string, feature string, severity string, coverage string, arrival bigint"
TYPES = [("NULL_HANDLING", "NULL_EMPTY_INPUTS"), ("EMPTY_INPUT", "NULL_EMPTY_INPUTS"), ("CONCURRENCY", "CONCURRENCY"), ("RETRY_BEHAVIOR", "RESILIENCE_RETRY_TIMEOUT")]


def gaps(n):
    return [
        (f"i{k * 7 % 23}", *TYPES[k * 5 % 4], f"F{k % 5}" if k % 6 else None, ["HIGH", "LOW", "CRITICAL"][k % 3], ["PARTIAL", "NOT_COVERED"][k % 2], k)
        for k in range(n)
    ]


def write_parts(spark, rows, schema, folder, parts, start=0):
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))


def plain(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


def test_runs_of_batches():
    assert ranges_after(0) == [] and ranges_after(11) == [(0, 8), (8, 10), (10, 11)] and ranges_after(8) == [(0, 8)]


def test_merged_partials_give_the_patterns_of_the_whole(spark, tmp_path):
    rows, path = gaps(70), str(tmp_path / "p")
    for batch in range(7):
        own = spark.createDataFrame(rows[batch * 10 : batch * 10 + 10], OBS)
        merge_batch(own, batch, path)
        now = merge_batch(own, batch, path)  # a repeated batch changes nothing
        whole = spark.createDataFrame(rows[: batch * 10 + 10], OBS)
        assert plain(pat.patterns_from(now)) == plain(pat.recurring_patterns(whole))
    assert {"0-4", "4-6", "6-7"} <= set(os.listdir(f"{path}/incidents")) and "0-1" not in os.listdir(f"{path}/incidents")


def test_a_batch_reads_only_itself_and_partials(spark, tmp_path):
    rows = gaps(60)
    source, out = tmp_path / "in", {k: str(tmp_path / k) for k in ("obs", "patterns", "check")}
    write_parts(spark, rows[:40], OBS, source, 4)

    def run():
        stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(str(source))
        start_intake(stream, lambda b: b, out["obs"], out["patterns"], out["check"]).awaitTermination()

    run()
    # Without the stored observations the next batches still know the whole history.
    import shutil

    shutil.move(out["obs"], str(tmp_path / "elsewhere"))
    write_parts(spark, rows[40:], OBS, source, 2)
    run()
    assert plain(current_patterns(spark, out["patterns"]).select("family_key", "incident_count", "gap_count", "features")) == plain(
        pat.recurring_patterns(spark.createDataFrame(rows, OBS)).select("family_key", "incident_count", "gap_count", "features"))
    assert spark.read.parquet(out["obs"]).count() == 20


SIGNALS = ["retry", "error_handling", "concurrency", "null"]
FACTS = "incident_id string, arrival bigint, family_key string, signals array<string>"


def facts(n):
    out = []
    for k in range(n):
        who = k * 11 % 37 if k % 3 else k % 5
        out.append((f"i{who}", k, TYPES[k * 7 % 4][1] if k % 5 else None, [SIGNALS[who % 4]] if who % 6 else []))
    return out


def expected(spark, rows):
    df = spark.createDataFrame(rows, FACTS)
    first = df.groupBy("incident_id").agg(F.min("arrival").alias("arrival"), F.min_by("signals", "arrival").alias("signals"))
    got = hist.recurrence_at_arrival(first, df.filter("family_key is not null"))
    return {r.incident_id: r.similar_incidents for r in got.collect()}


def test_running_recurrence_survives_a_restart(spark, tmp_path):
    rows, source, out, check = facts(120), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(str(source))
        start_recurrence(stream, out, check, slices=3).awaitTermination()

    write_parts(spark, rows[:60], FACTS, source, 2)
    run()
    write_parts(spark, rows[60:], FACTS, source, 2)
    run()
    got = {r.incident_id: r.similar_incidents for r in recurrence_so_far(spark, out).collect()}
    assert got == expected(spark, rows) and max(got.values()) > 3
    assert recurrence_so_far(spark, out).count() == len(got)


def test_late_incidents_count_what_came_before_them(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    early = [("a", 10, "CONCURRENCY", []), ("b", 20, "CONCURRENCY", []), ("c", 30, "CONCURRENCY", ["concurrency"])]
    late = [("d", 15, None, ["concurrency"]), ("e", 20, "CONCURRENCY", ["concurrency"]), ("f", 40, None, ["concurrency"]), ("a", 50, "CONCURRENCY", ["concurrency"])]
    write_parts(spark, early, FACTS, source, 1)
    write_parts(spark, late, FACTS, source, 1)
    stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    start_recurrence(stream, out, str(tmp_path / "check"), slices=2).awaitTermination()
    got = {r.incident_id: r.similar_incidents for r in recurrence_so_far(spark, out).collect()}
    assert got == {"a": 0, "b": 0, "c": 2, "d": 1, "e": 2, "f": 4}


def test_late_rows_are_dropped_by_rule(spark, tmp_path):
    schema = "ts timestamp, family_key string, coverage string"
    source, out = tmp_path / "in", str(tmp_path / "out")

    def batch(*rows):
        df = spark.createDataFrame([(t, f, "PARTIAL") for t, f in rows], "ts string, family_key string, coverage string")
        df.select(F.col("ts").cast("timestamp").alias("ts"), "family_key", "coverage").coalesce(1).write.mode("append").parquet(str(source))

    batch(("2024-01-01 01:00:00", "A"), ("2024-01-01 02:00:00", "B"))
    batch(("2024-01-02 05:00:00", "A"), ("2024-01-01 23:00:00", "A"))
    batch(("2024-01-05 00:00:00", "A"))
    batch(("2024-01-05 01:00:00", "A"))
    # The first day ended more than a day before the newest row of the third batch: dropped; the fourth is still open.
    batch(("2024-01-01 03:00:00", "A"), ("2024-01-04 03:00:00", "B"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    start_trend(stream, out, str(tmp_path / "check")).awaitTermination()
    got = sorted((str(r.start)[:10], r.family_key, r.n) for r in current_trend(spark, out).collect())
    assert got == [("2024-01-01", "A", 2), ("2024-01-01", "B", 1), ("2024-01-02", "A", 1), ("2024-01-04", "B", 1), ("2024-01-05", "A", 2)]
