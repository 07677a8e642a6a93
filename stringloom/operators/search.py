"""Text and column search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_pattern, line_of


def search_lines(lines: DataFrame, pattern: str, ignore_case: bool = False, column: str = "value") -> DataFrame:
    return lines.where(contains_pattern(F.col(column), pattern, ignore_case))


def files_matching(lines: DataFrame, pattern: str, ignore_case: bool = False, file: str = "file") -> DataFrame:
    return search_lines(lines, pattern, ignore_case).select(file).distinct()


def count_matches(lines: DataFrame, pattern: str, ignore_case: bool = False, file: str = "file") -> DataFrame:
    """Per file: matching lines, and occurrences over all of them."""
    flagged = ("(?i)" if ignore_case else "") + pattern
    return (
        search_lines(lines, pattern, ignore_case).groupBy(file)
        .agg(F.count(F.lit(1)).alias("matching_lines"),
             F.sum(F.regexp_count("value", F.lit(flagged))).alias("occurrences"))
    )


def search_column(df: DataFrame, column: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    return df.where(contains_pattern(F.col(column), pattern, ignore_case))


def search_rows(df: DataFrame, pattern: str, columns: Sequence[str] | None = None,
                ignore_case: bool = False) -> DataFrame:
    """Rows whose line of text matches; with ``columns`` only those are kept and searched."""
    chosen = df.select(*columns) if columns else df
    return chosen.where(contains_pattern(line_of(chosen), pattern, ignore_case))


def count_rows_matching(df: DataFrame, pattern: str, columns: Sequence[str],
                        ignore_case: bool = False) -> DataFrame:
    return search_rows(df, pattern, columns, ignore_case).agg(F.count(F.lit(1)).alias("matches"))


def extract_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row per match of ``pattern``, with the other columns of its row."""
    found = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
    return df.select("*", F.explode(found).alias("match"))
