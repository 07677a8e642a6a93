"""Vector codes: each vector is cut into equal parts and every part becomes the index of its codebook's nearest entry.

Nearest entries are looked up by coarse grid cells. A part's cell is hashed into a cache which holds, for each cell met so far, the entries that can
be nearest somewhere in its box: an entry goes if another one's largest distance to the box lies below its own least distance. Only the entries that
stay are evaluated exactly, in whole numbers, so the codes equal those of a full search. The cache only saves work; its size is fixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import salted_join
from .runtime import prepare, written
from .words import mixed

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components count as at most this in size after scaling, so that every distance is an exact 64-bit number.
LARGEST = 1 << 22
#: Cells that the cache of a task holds.
CELLS = 1 << 16


class Codebooks:
    """Entries (part, entry, component) and the cache of cells. ``widths`` are the sides of each part's cells, powers of two."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        parts, self.count, self.size = entries.shape
        spread = entries.std(axis=1).mean(axis=1)
        self.shift = np.maximum(0, np.round(np.log2(np.maximum(spread / 2, 1)))).astype(np.int64)
        self.cells = np.zeros((CELLS, self.size), dtype=np.int64)
        self.owner = np.full(CELLS, -1, dtype=np.int64)
        self.open = np.zeros((CELLS, self.count), dtype=bool)
        self.weights = np.random.default_rng(11).integers(1, 2**63, self.size + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.evaluated = self.met = 0

    def _undominated(self, part: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Entries that can be nearest somewhere in each cell's box, ties included."""
        low = (cells << self.shift[part][:, None])[:, None, :]
        high = low + (np.int64(1) << self.shift[part])[:, None, None] - 1
        entries = self.entries[part]
        least = np.maximum(np.maximum(low - entries, entries - high), 0)
        most = np.maximum(np.abs(entries - low), np.abs(entries - high))
        return (least * least).sum(axis=2) <= (most * most).sum(axis=2).min(axis=1)[:, None]

    def _candidates(self, part: np.ndarray, cells: np.ndarray) -> np.ndarray:
        keys = mixed((cells.view(np.uint64) * self.weights[1:]).sum(axis=1, dtype=np.uint64) + part.astype(np.uint64) * self.weights[0])
        slot = (keys & np.uint64(CELLS - 1)).astype(np.int64)
        out = self.open[slot]
        missing = np.flatnonzero((self.owner[slot] != part) | (self.cells[slot] != cells).any(axis=1))
        if len(missing):
            _, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            for begin in range(0, len(first), 4096):
                some = missing[first[begin:begin + 4096]]
                at = slot[some]
                self.open[at], self.owner[at], self.cells[at] = self._undominated(part[some], cells[some]), part[some], cells[some]
                mine = (back >= begin) & (back < begin + 4096)
                out[missing[mine]] = self._undominated(part[some], cells[some])[back[mine] - begin]
            same = missing[first[back]]
            alike = (part[same] == part[missing]) & (cells[same] == cells[missing]).all(axis=1)
            out[missing[~alike]] = True  # two cells with one hash: all entries are evaluated
        return out

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of whole-numbered vectors, ties to the lower entry."""
        n, parts = len(values), len(self.entries)
        flat = values.reshape(n * parts, self.size)
        part = np.tile(np.arange(parts), n)
        open_ = self._candidates(part, flat >> self.shift[part][:, None])
        row, entry = np.nonzero(open_)
        self.met, self.evaluated = self.met + len(flat), self.evaluated + len(row)
        gap = flat[row] - self.entries[part[row], entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        begin = np.searchsorted(row, np.arange(len(flat)))
        least = np.minimum.reduceat(distance, begin)
        at = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(begin, len(row)))))
        chosen = at[np.searchsorted(row[at], np.arange(len(flat)))]
        return entry[chosen].reshape(n, parts), least.reshape(n, parts)


def _kept(vector: str) -> Column:
    """Rows with a vector of finite components."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(F.col(vector), lambda x: F.coalesce(real(x), F.lit(False))), F.lit(False))


def _whole(column: pa.Array, size: int) -> np.ndarray:
    """Scaled and floored components of the vectors, one row for each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(-1, size)


def _sums(books, size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codebooks(books.value)
        parts, count, width = known.entries.shape
        sums, rows = np.zeros((parts * count, width), dtype=np.int64), np.zeros(parts * count, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                values = _whole(batch.column(0), size)
                at = (known.nearest(values)[0] + np.arange(parts) * count).ravel()
                np.add.at(sums, at, values.reshape(-1, width))
                rows += np.bincount(at, minlength=len(rows))
        used = np.flatnonzero(rows)
        entry, place = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(place), pa.array(sums[used].ravel()), pa.array(np.repeat(rows[used], width))],
                                         names=["entry", "place", "total", "rows"])
    return scan


def _coded(books, size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codebooks(books.value)
        digits = [f"{k:02x}" for k in range(known.count)]
        for batch in batches:
            if batch.num_rows:
                entry, distance = known.nearest(_whole(batch.column(2), size))
                codes = ["".join(map(digits.__getitem__, row)) for row in entry.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))],
                                                 names=["vec_id", "label", "code", "error"])
    return scan


def first_entries(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """Starting codebooks (part, entry, component) from the ``entries`` smallest ids; no row is read beyond those."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    rows = vectors.orderBy(*order).limit(entries).select("vector").collect()
    if not rows:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    size = len(rows[0][0])
    values = _whole(pa.array([r[0] for r in rows if len(r[0]) == size]), size)
    return np.ascontiguousarray(values.reshape(len(values), parts, size // parts).transpose(1, 0, 2))


def trained(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds of assignment and floored means.

    A task returns one row for each component of the entries it used; the sums of all tasks meet by a grouped sum, and as many numbers as the
    codebooks hold reach the driver.
    """
    context = vectors.sparkSession.sparkContext
    parts, count, width = books.shape
    for _ in range(rounds):
        found = vectors.select("vector").mapInArrow(_sums(context.broadcast(books), parts * width), "entry long, place long, total long, rows long")
        means = found.groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect()
        books = books.copy()
        for r in means:
            books[r["entry"] // count, r["entry"] % count, r["place"]] = r["total"] // r["rows"]
    return books


def vector_codes(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row whose vector has only finite components.

    A null vector, or one with a null or non-finite component, drops the row. Components are floored after scaling by 256; beyond +-2^22 they
    count as that. Vectors have one length, that of the smallest id's vector, a multiple of ``parts``; a row with another length (empty
    vectors too) keeps null in code and error. Distances that tie go to the lower entry, equal ids are ordered by their vectors for the first
    codebook, rows without an id come last there, and repeated rows count as often as they stand. Fewer rows than entries give
    smaller codebooks; an empty table gives no rows. Null labels are one label. Other columns, very long or empty texts among them, are ignored
    whatever their names.
    """
    spark = table.sparkSession
    prepare(spark)
    rows = table.where(_kept(vector)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    fitting = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    books = first_entries(rows.where(fitting), entries, parts)
    size = parts * books.shape[2]
    fits = F.size("vector") == size if books.size else F.lit(False)
    whole = rows.where(fits)
    if books.size:
        books = trained(whole, books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    coded = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books.size:
        coded = whole.select("vec_id", "label", "vector").mapInArrow(_coded(spark.sparkContext.broadcast(books), size), schema).unionByName(coded)
    coded = written(coded.withColumn("same", F.xxhash64(F.col("label").isNull(), "label")), "codes")
    sums = written(coded.groupBy("same").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label_errors")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    out = salted_join(coded, sums, "same", "rows", total, "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
