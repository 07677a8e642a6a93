"""Global row positions without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def with_position(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Number rows 0..n-1 in ``order`` (which must identify rows, so ranges can be balanced).

    Range partitioning spreads the sort. Each row is stored with its partition and its place in it;
    the per-partition totals (one row per partition) turn places into global positions.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    sliced = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    stored = written(sliced, "ranked")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("_slice").count()
        .select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    # one row per partition of the stored table, so the broadcast is bounded by the partition count
    return (
        stored.join(F.broadcast(starts), "_slice")
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_slice", "_place", "_start")
    )
