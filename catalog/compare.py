"""Order-free comparison of a query result with its SQL counterpart."""

from __future__ import annotations

import math

import pandas as pd


def _cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def _rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None))


def matches(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, otherwise what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _rows(got), _rows(want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
