"""Stored intermediate tables, block counts, and order-safe numbering."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Rows of a block that is sent to every task: far below what one executor can
# keep, and never dependent on how large the other side is.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder the cluster names in
    ``spark.checkpoint.dir``, which the driver and all executors share.  Only
    where that is unset, as in tests, the warehouse serves instead."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate").rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """A reduced result that several later steps read, written as Parquet to the
    shared folder and read back.

    Cuts the lineage, survives lost executors, and gives later plans real sizes,
    column pruning and pushed filters, so Spark itself picks broadcast joins.
    """
    void = {f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if f.dataType.typeName() == "void"}
    df = df.withColumns(void) if void else df
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_for(n_rows: int, rows: int = BROADCAST_ROWS) -> int:
    return max(1, math.ceil(n_rows / rows))


def ordinal_within(
    df: DataFrame, keys: list[str], order: list[Column], coarse: Column | None = None, name: str = "ordinal"
) -> DataFrame:
    """1-based position of every row inside its key, in ``order``.

    A plain window sorts a whole key in one task.  With ``coarse`` -- any
    expression that never decreases along ``order`` -- rows are numbered inside
    ``(key, coarse)`` and shifted by the number of rows in earlier steps of the
    same key, so a key holding a third of the table is spread over all its
    steps.  The step counts combine map-side before they are shuffled.
    """
    if coarse is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    df = df.withColumn("_step", coarse)
    before = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        df.groupBy(*keys, "_step")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_step").orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(steps.select(*keys, "_step", "_before"), [*keys, "_step"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_step", "_inside", "_before")
    )


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its key, in ``order``; ``keys`` are not null.

    Rows are spread by ranges of (key, order), so a key that holds most rows lies
    in many tasks.  Each task sums inside its own range; what the ranges hold of
    each key is summed apart -- as many numbers as there are ranges and keys
    together -- and added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = [F.col(k).asc() for k in keys] + order
    ranged = materialise(df.repartitionByRange(n, *placed).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
        .select(*keys, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(before, [*keys, "_range"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_before")
    )
