"""Decisions that rest on a known size."""

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many tasks as the cluster runs at once.

    For per-row Python over a table of few small splits; a table with enough splits
    stays as it is. ``df`` must come straight from a scan: then its splits are known
    without running anything.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)
