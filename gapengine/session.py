"""Session settings the analyses run well with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings only; sizes of the cluster stay the caller's business.

    Column expressions here are heavy for their bytes, so small shuffles keep
    more, smaller partitions; skewed join partitions are split at run time.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Inferring constraints costs more than it prunes on wide nested projections.
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    return spark
