"""Column and row operations of a delimited-table toolkit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranking import with_position


def headers(df: DataFrame) -> DataFrame:
    """(index, name) of each column, counted from one."""
    spark: SparkSession = df.sparkSession
    rows = [(at, name) for at, name in enumerate(df.columns, start=1)]
    return spark.createDataFrame(rows, "`index` int, name string")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def slice_rows(df: DataFrame, order: Sequence[str], start: int, length: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(length)


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def sort_rows(df: DataFrame, column: str, tie_break: str, numeric: bool = False) -> DataFrame:
    """Rows with their place in the sorted order; values compare as text unless ``numeric``."""
    text = F.col(column).cast("string")
    key = F.expr(f"try_cast(`{column}` as double)") if numeric else text
    return with_position(df, [key, F.col(tie_break)], "sorted_position")


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: sum, min, max, shortest and longest text, mean, population deviation.

    Numeric columns compare as numbers, others as text with NULL sum, mean and deviation. One pass.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns:
        cell, text = F.col(name), F.col(name).cast("string")
        numeric = isinstance(types[name], T.NumericType)
        number = cell.cast("double") if numeric else F.lit(None).cast("double")
        parts.append(F.struct(
            F.lit(name).alias("field"), F.sum(number).alias("sum"),
            F.min(cell).cast("string").alias("min"), F.max(cell).cast("string").alias("max"),
            F.min(F.length(text)).alias("min_length"), F.max(F.length(text)).alias("max_length"),
            F.avg(number).alias("mean"), F.stddev_pop(number).alias("stddev")).alias(f"s_{name}"))
    wide = df.agg(*parts)
    return wide.select(F.explode(F.array(*[F.col(f"s_{n}") for n in columns])).alias("s")).select("s.*")
