"""Hashed byte n-gram counts of whole texts, one row of a dense matrix for each text of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import LOWER, Words

#: Letters in lower case, any other ASCII character as a space.
LETTERS = LOWER.copy()
LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32
#: Kinds of characters: letters, capitals, digits and bytes beyond ASCII by one sign each, spaces and marks as they are.
KINDS = np.arange(256, dtype=np.uint8)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:] = ord("a"), ord("A"), ord("0"), ord("a")


def gram_counts(words: Words, signs: np.ndarray, widths: tuple[int, ...], buckets: int) -> np.ndarray:
    """Counts of the byte n-grams of each row in ``buckets`` (a power of two) columns, as float32; n-grams never cross rows."""
    data = signs[words.data].astype(np.uint64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    out = np.zeros(words.rows * buckets, dtype=np.float32)
    row = np.repeat(np.arange(words.rows), np.diff(words.offsets))
    for n in widths:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[k:len(data) - n + 1 + k]
        whole = row[:len(code)] == row[n - 1:]
        at = row[:len(code)][whole] * buckets + ((code[whole] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        out += np.bincount(at, minlength=len(out)).astype(np.float32)
    return out.reshape(words.rows, buckets)


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def fold_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the hold-out folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def packed_rows(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as binary values."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, dtype=np.float32)], pa.binary())


def unpacked_rows(column, width: int) -> np.ndarray:
    values = column.to_pylist()
    return np.stack([np.frombuffer(v, dtype=np.float32) for v in values]) if values else np.zeros((0, width), dtype=np.float32)
