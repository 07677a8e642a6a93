"""Record cleansing: required columns, source filter, reshaping, exclusion, counts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Required columns, kept source and dropped columns of a record sheet.
REQUIRED = ("DataSourceName", "Dimension Value", "Owner", "NCM", "Year", "Month")
KEPT_SOURCE = "Base Brasil - Logcomex"
DROPPED = ("DataSourceName", "Year", "Month")


class ColumnCheck(NamedTuple):
    ok: bool
    missing: set[str]
    extra: set[str]


class MissingColumns(ValueError):
    """Required columns are absent."""


def check_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> ColumnCheck:
    """Compare the schema with the required set; extra columns are tolerated."""
    present, wanted = set(df.columns), set(required)
    return ColumnCheck(wanted <= present, wanted - present, present - wanted)


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    check = check_columns(df, required)
    if not check.ok:
        raise MissingColumns(f"missing {sorted(check.missing)}; extra {sorted(check.extra)}")
    return df


def column_report(df: DataFrame, name: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """(table, rows, ok, missing, extra): the check of one table as a row, names sorted."""
    check = check_columns(df, required)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table"), "rows", F.lit(check.ok).alias("ok"), F.lit(", ".join(sorted(check.missing))).alias("missing"),
        F.lit(", ".join(sorted(check.extra))).alias("extra"))


def keep_source(df: DataFrame, source: str = KEPT_SOURCE, column: str = "DataSourceName") -> DataFrame:
    return df.where(F.col(column) == F.lit(source))


def drop_columns(df: DataFrame, columns: Sequence[str] = DROPPED) -> DataFrame:
    return df.drop(*columns)


def arrange(df: DataFrame) -> DataFrame:
    """``Owner``, ``NCM``, an empty unnamed column, ``Dimension Value``, in that order."""
    require_columns(df, ("Owner", "NCM", "Dimension Value"))
    return df.select("Owner", "NCM", F.lit("").alias(""), "Dimension Value")


def prepare_records(df: DataFrame, source: str = KEPT_SOURCE) -> DataFrame:
    """Sheet rows to scoring input: validate, keep one source, drop and arrange columns."""
    return arrange(drop_columns(keep_source(require_columns(df), source)))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.na.drop(subset=[column])


def second_column(df: DataFrame) -> str:
    if len(df.columns) < 2:
        raise MissingColumns("the exclusion list needs a second column")
    return df.columns[1]


def exclude_listed(df: DataFrame, listed: DataFrame, owner: str = "Owner",
                   company: str | None = None) -> DataFrame:
    """Rows whose owner is not on the list. A NULL owner stays unless the list holds a NULL.

    No broadcast is forced: the list may grow, so its measured size decides the join.
    """
    name = company or second_column(listed)
    names = listed.select(F.col(f"`{name}`").alias("_listed")).distinct()
    return df.join(names, F.col(f"`{owner}`").eqNullSafe(F.col("_listed")), "left_anti")


def kept_counts(df: DataFrame, keep: Column) -> DataFrame:
    """(rows_before, rows_after, rows_removed) of a filter, in one aggregate."""
    after = F.count_if(F.coalesce(keep, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("rows_before"), after.alias("rows_after"),
                  (F.count(F.lit(1)) - after).alias("rows_removed"))


def exclusion_counts(df: DataFrame, listed: DataFrame, owner: str = "Owner", company: str | None = None) -> DataFrame:
    """(rows_before, rows_after, rows_removed) of ``exclude_listed`` itself."""
    after = exclude_listed(df, listed, owner, company).agg(F.count(F.lit(1)).alias("rows_after"))
    # one row each side
    both = df.agg(F.count(F.lit(1)).alias("rows_before")).join(F.broadcast(after))
    return both.select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach a row counter that fills in while another action runs."""
    counter = Observation(name)
    return df.observe(counter, F.count(F.lit(1)).alias("rows")), counter


def describe_text(df: DataFrame, column: str) -> DataFrame:
    """count, unique, top, freq of a text column; the smallest value wins a tie for top."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    best = F.min_by("value", F.struct((-F.col("n")).alias("n"), "value"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count("value").alias("unique"),
                     best.alias("top"), F.max("n").alias("freq"))
