"""Scalar expressions over text and probabilities."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word pattern (runs of two or more word characters).
WORD = r"[\p{L}\p{N}_]{2,}"

# Cell texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def words(text: Column) -> Column:
    """Lower-cased words of ``text`` in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


@F.arrow_udf(T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]))
def word_counts(words: pa.Array) -> pa.Array:
    """Distinct words of each row's list and how often they stand there; a null list has none."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    pairs, counts = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    ends = pa.array(np.searchsorted(pairs, np.arange(len(lengths) + 1) * width), pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % width))),
                                       pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))], names=["terms", "counts"])


def smoothed_idf(rows: Column, rows_with_term: Column) -> Column:
    return F.log((F.lit(1.0) + rows) / (F.lit(1.0) + rows_with_term)) + F.lit(1.0)


def unit_distance(cosine: Column) -> Column:
    """Euclidean distance between two unit vectors."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * cosine))


def three_decimals(value: Column) -> Column:
    """Probability text with three decimals, rounding the stored binary value half to even."""
    # 0.0005 is stored slightly above the tie and is the one value the formatter takes down
    return F.when(value == F.lit(0.0005), F.lit("0.001")).otherwise(F.call_function("format_number", value, F.lit("0.000")))


def joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def blank_to_null(df: DataFrame, columns: Sequence[str] | None = None,
                  tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Turn missing-value texts into NULL in the string columns (or the named ones)."""
    names = columns if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    listed = list(tokens)
    out = {}
    for name in names:
        cell = F.col(f"`{name}`")
        out[name] = F.when(~cell.isin(listed), cell)
    return df.withColumns(out) if out else df


def line_of(df: DataFrame, columns: Sequence[str] | None = None, sep: str = ",") -> Column:
    """The row as one line of text; NULL cells are empty, as in a delimited file."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (columns or df.columns)]
    return F.concat_ws(sep, *cells)


def contains_pattern(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + pattern)
