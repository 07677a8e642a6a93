"""What every operator here needs from the session: shipped code, small Arrow batches, written intermediates."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import written

__all__ = ["prepare", "table", "written", "string_column", "batch_rows", "fresh_names"]

#: Python tasks hold one Arrow batch at a time; both limits only bound memory, never what is processed.
BATCH_ROWS = 1_000
BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers (once) and bound the Arrow batches they receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "llm_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    context._llm_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_column(column: pa.Array) -> list[str]:
    """Texts of a column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def batch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have rows."""
    return (b for b in batches if b.num_rows)


def fresh_names(frame: DataFrame, *wanted: str) -> list[str]:
    """Column names for temporary use that ``frame`` does not have."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in wanted:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out
