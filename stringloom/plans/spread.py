"""Enough partitions for expensive row work on inputs stored in few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the input lies in fewer files than the session has slots.

    A large table has more files than slots and passes through without a shuffle. The file list is known to the planner, so asking runs no job.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if len(df.inputFiles()) < slots else df
