"""Cluster numbers of the report table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.ranking import with_position
from ...plans.scratch import written
from ...plans.skew import salted_join

NOISE = -1


def by_label(assigned: DataFrame) -> DataFrame:
    """Labels 0..k-1 become clusters 1..k."""
    return assigned.withColumns({"is_noise": F.col("label") == NOISE, "cluster": F.col("label") + 1})


def by_first_appearance(assigned: DataFrame) -> DataFrame:
    """Number (id, label) groups 1, 2, ... by their smallest id; noise is numbered like any other group."""
    stored = written(assigned, "assigned")
    groups = stored.groupBy("label").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    total = stored.count()
    numbered = with_position(groups, ["first"], "place").select("label", "n", (F.col("place") + 1).alias("cluster"))
    out = salted_join(stored, numbered, "label", "n", total, "id")
    return out.select("id", "label", (F.col("label") == NOISE).alias("is_noise"), "cluster")


def cluster_table(clusters: DataFrame, strings: DataFrame) -> DataFrame:
    """(cluster, id, string): the report rows; write or show them ordered by cluster, then id."""
    return clusters.join(strings, "id").select("cluster", "id", "string")


def report_order(clusters: DataFrame) -> DataFrame:
    """Rows with their place in the report: by cluster, then in input order."""
    return with_position(clusters.select("cluster", "id"), ["cluster", "id"])


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))
