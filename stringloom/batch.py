"""The whole scoring run: prepare, exclude, score every target, write all outputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import clean, report
from .plans.scratch import written
from .sources import sinks

Scorer = Callable[[DataFrame], DataFrame]


class StageFailed(RuntimeError):
    """A stage raised; later stages were not started."""


def score_targets(prepared: DataFrame, scorers: Mapping[str, Scorer]) -> dict[str, DataFrame]:
    """One scored and routed frame per target over the same prepared rows."""
    return {target: report.route(report.report_columns(scorer(prepared), target)) for target, scorer in scorers.items()}


def run_batch(records: DataFrame, exclusions: DataFrame, scorers: Mapping[str, Scorer], source: str, out: str) -> DataFrame:
    """(output, rows) of everything this run wrote below ``out``; stops at the first stage that fails.

    ``scorers`` add ``classes`` to rows with ``id``, ``Owner``, ``NCM``, an empty column and ``Dimension Value``.
    """
    stage = "prepare"
    try:
        kept = clean.exclude_listed(clean.prepare_records(records, source), exclusions)
        prepared = written(kept.withColumn("id", F.monotonically_increasing_id()), "prepared")  # stored once, so ids are stable
        outputs = []
        for target, scorer in scorers.items():
            stage = f"score {target}"
            routed = score_targets(prepared, {target: scorer})[target].drop("classes", "top_3")
            path = f"{out}/predictions_{target.lower()}"
            sinks.write_routed(routed, path)
            back = prepared.sparkSession.read.parquet(path)
            sinks.write_summary(report.confidence_histogram(back), f"{out}/confidence_distribution_{target.lower()}")
            # both routed outputs are listed, also without rows; rows without a confidence only where there are some
            counted = back.select(*(F.count_if(F.col("bucket") == b).alias(b) for b in report.BUCKETS))
            listed = counted.select(F.explode(F.array(*(
                F.struct(F.lit(b).alias("bucket"), F.col(b).alias("rows")) for b in report.BUCKETS))).alias("o")).select("o.*")
            outputs.append(listed.where((F.col("bucket") != report.UNROUTED) | (F.col("rows") > 0)).select(
                F.concat_ws("_", "bucket", F.lit(target.lower())).alias("output"), "rows"))
            outputs.append(report.confidence_histogram(back).agg(F.sum("Count").alias("rows")).select(
                F.lit(f"summary_{target.lower()}").alias("output"), "rows"))
    except Exception as error:
        raise StageFailed(f"{stage}: {error}") from error
    result = outputs[0]
    for more in outputs[1:]:
        result = result.unionByName(more)
    return result
