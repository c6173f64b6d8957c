"""Helpers of the training-data operators: stored intermediate tables, ranks and running sums without hot tasks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gapengine.operators.sizing import shared_folder

C = F.col
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives later plans real
    sizes, so Spark itself knows which side of a join is small.  The shuffle
    files that made it are deleted, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_folder(spark)
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/llm/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/llm/{name.rpartition('/')[2]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its key, in ``order``.

    Rows are range-partitioned by key and order together, so that a key of any
    size spans many tasks; each task sums its own piece, and the totals of the
    pieces, a few per key, are added up separately.  ``keys`` must not be null.
    """
    n = partitions(df.sparkSession)
    cols = [*keys, *order]
    ranged = stored(df.repartitionByRange(n, *[C(c).asc_nulls_first() for c in cols]).withColumn("_piece", F.spark_partition_id()))
    piece = Window.partitionBy("_piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        ranged.groupBy(*keys, "_piece").agg(F.sum(value).alias("_total"))
        .withColumn("_earlier", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .filter(C("_earlier") != 0).select(*keys, "_piece", "_earlier")
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(piece), F.lit(0)))
        .join(pieces, [*keys, "_piece"], "left")
        .withColumn(out, (C("_inside") + F.coalesce(C("_earlier"), F.lit(0))).cast("bigint"))
        .drop("_piece", "_inside", "_earlier")
    )


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based position of every row in ``order``; the result is stored.

    No task holds more than one range of the rows; only the number of rows of
    each range, as many numbers as there are partitions, meets in one place.
    """
    n = partitions(df.sparkSession)
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")).select(
        "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy(*order)) - 1
    # One row per partition: small whatever the data.
    return ranged.withColumn("_inside", inside).join(F.broadcast(pieces), "_piece").withColumn(
        out, (C("_before") + C("_inside")).cast("bigint")
    ).drop("_piece", "_inside", "_before")


# A bitmap over ids of 4 MB, whatever the number of ids.
FILTER_BITS = 25


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the place of every id (one bigint column) is set.

    The more ids there are, the more others pass.  It saves shuffling rows that
    the join behind it would not keep, and decides nothing itself.
    """
    x = C(ids.columns[0])
    place = x.bitwiseXOR(F.shiftright(x, FILTER_BITS)).bitwiseXOR(F.shiftright(x, 2 * FILTER_BITS)).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    parts = ids.filter(x.isNotNull()).select(F.shiftright(place, 5).alias("word"), F.pow(F.lit(2), place % 32).cast("bigint").alias("bit"))
    found = parts.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def in_filter(bitmap: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which of ``ids`` may be in the filter; nulls are not."""
    x = ids.fill_null(0).to_numpy(zero_copy_only=False)
    place = (x ^ (x >> FILTER_BITS) ^ (x >> (2 * FILTER_BITS))) & ((1 << FILTER_BITS) - 1)
    there = (bitmap[place >> 5] >> (place & 31).astype(np.uint32)) & 1
    return there.astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
