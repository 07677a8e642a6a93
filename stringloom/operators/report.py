"""Prediction reports: top classes, confidence, routing, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined, three_decimals

# Confidence threshold and histogram ranges.
THRESHOLD = 0.90
RANGES = ("0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")
EDGES = (0.2, 0.4, 0.6, 0.8)
UNROUTED = "unrouted"
BUCKETS = ("high", "review", UNROUTED)


def top_classes(classes: Column, k: int = 3) -> Column:
    """The ``k`` most probable entries of array<struct<label, prob>>; ties keep class order."""
    by_rank = F.array_sort(
        F.transform(classes, lambda c, at: F.struct((-c["prob"]).alias("down"), at.alias("at"), c.alias("entry"))))
    return F.transform(F.slice(by_rank, 1, k), lambda c: c["entry"])


def report_columns(scored: DataFrame, target: str, classes: str = "classes") -> DataFrame:
    """Add predicted label, top-3 labels and probabilities (arrays and text) and the confidence."""
    top = F.col("top_3")
    return (
        scored.withColumn("top_3", top_classes(F.col(classes)))
        .withColumns({
            f"Predicted_{target}": F.get(top, F.lit(0))["label"],
            "Top_3_Predictions": joined(F.transform(top, lambda c: c["label"])),
            "Top_3_Probabilities": joined(F.transform(top, lambda c: three_decimals(c["prob"]))),
            "Confidence": F.array_max(F.transform(F.col(classes), lambda c: c["prob"])),
        })
    )


def route(scored: DataFrame, threshold: float = THRESHOLD, confidence: str = "Confidence") -> DataFrame:
    """Mark rows ``high``, ``review`` or, without a confidence, ``unrouted``."""
    value = F.col(confidence)
    return scored.withColumn("bucket", F.when(value >= threshold, "high").when(value < threshold, "review")
                             .otherwise(UNROUTED))


def bucket_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))


def confidence_histogram(scored: DataFrame, confidence: str = "Confidence") -> DataFrame:
    """(Confidence_Range, Count): always five rows, from a single aggregate."""
    value = F.col(confidence)
    lower = (None,) + EDGES
    upper = EDGES + (None,)
    counts = []
    for name, low, high in zip(RANGES, lower, upper):
        inside = F.lit(True) if low is None else value >= low
        inside = inside if high is None else inside & (value < high)
        counts.append(F.struct(F.lit(name).alias("Confidence_Range"), F.count_if(inside).alias("Count")))
    return scored.agg(F.array(*counts).alias("h")).select(F.explode("h").alias("r")).select("r.*")


def accuracy(scored: DataFrame, predicted: str, actual: str) -> DataFrame:
    right = (F.col(predicted) == F.col(actual)).cast("double")
    return scored.agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("rows"))
