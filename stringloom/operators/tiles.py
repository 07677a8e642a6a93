"""Asking rows against all rows in tiles: every pair is compared inside some task, and only what the comparison keeps leaves it.

Rows are stored once, in packed blocks of bounded size. Pairs of blocks come from a Cartesian product of the stored blocks, whose tasks read them again, so
no row is shuffled for the blocks it meets; each pair is compared in matrices of dot products of at most ``ROWS`` times ``ROWS`` numbers. Where all rows
ask, a pair of blocks meets once, for both directions. No list of pairs is ever made. The work is (asking rows) x (rows); it is for questions that have no
radius to prune by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

#: Rows of a side of one matrix.
ROWS = 1_024
#: Rows and stored entries of a block. They bound a task's memory and do not grow with the data.
BLOCK = 8_192
ENTRIES = 3_000_000
#: Bytes of blocks that a task holds for one side of its pairs; more bytes mean more tasks. It does not grow with the data.
HELD = 128 << 20
#: Entries that are dealt anew before they are packed, because they lie in too few files to keep all slots busy.
FEW = 20_000_000
#: Bytes of values by vec that are broadcast to the blocks.
SPREAD = 64 << 20
#: Rows of answers that a task collects before it keeps only what is asked.
ANSWERS = 500_000
#: Shared terms of a tile that hold this share of all its pairs are multiplied as dense columns, the others entry by entry.
DENSE = 0.01
COLUMNS = 2_048
PRODUCTS = 1 << 22


class Side:
    """Rows of one block: flat terms and weights, the row of each entry, and the other columns as arrays."""

    def __init__(self, table: pa.Table, others: list[str]):
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        lengths = table.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        self.size = table.num_rows
        self.terms, self.weights = flat("terms"), flat("weights")
        self.owner = np.repeat(np.arange(self.size), lengths)
        self.squares = np.bincount(self.owner, weights=self.weights * self.weights, minlength=self.size)
        self.columns = {}
        for name in others:
            column = table.column(name).combine_chunks()
            if pa.types.is_list(column.type):
                self.columns[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(self.size, -1)
            else:
                self.columns[name] = column.to_numpy(zero_copy_only=False)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def rows(self, begin: int, stop: int) -> Side:
        """Some neighbouring rows as a side of their own."""
        part, stop = object.__new__(Side), min(stop, self.size)
        low, high = np.searchsorted(self.owner, [begin, stop])
        part.size, part.terms, part.weights, part.owner = stop - begin, self.terms[low:high], self.weights[low:high], self.owner[low:high] - begin
        part.squares, part.columns = self.squares[begin:stop], {n: c[begin:stop] for n, c in self.columns.items()}
        return part

    def parts(self, rows: int) -> list[Side]:
        """The rows in sides of at most ``rows``."""
        return [self.rows(begin, begin + rows) for begin in range(0, self.size, rows)]

    def by_term(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different terms, where the entries of each begin and end, and the entries' rows and weights in that order."""
        if "sorted" not in self.__dict__:
            by = np.argsort(self.terms, kind="stable")
            terms, begin = np.unique(self.terms[by], return_index=True)
            self.sorted = terms, np.append(begin, len(by)), self.owner[by], self.weights[by]
        return self.sorted

    def packed(self) -> bytes:
        """Parts of at most ROWS rows: their entries by term and their other columns, compressed."""
        columns: dict[str, list[np.ndarray]] = {}
        for part in self.parts(ROWS):
            terms, begin, owner, weights = part.by_term()
            made = {"size": np.array([part.size]), "terms": terms, "begin": begin.astype(np.int32), "owner": owner.astype(np.int32), "weights": weights}
            for name, values in (made | {f"_{n}": c.ravel() for n, c in part.columns.items()}).items():
                columns.setdefault(name, []).append(values)
        lists = {n: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c))) for n, c in columns.items()}
        return stream(pa.table(lists))

    @staticmethod
    def unpacked(data: pa.Buffer, more: pa.Buffer | None = None) -> list[Side]:
        """The packed parts, which hold their entries by term only. ``more`` has further columns by vec."""
        table, out = pa.ipc.open_stream(data).read_all().combine_chunks(), []
        added = pa.ipc.open_stream(more).read_all().combine_chunks().sort_by("vec") if more is not None else None
        for i in range(table.num_rows):
            flat = {name: table.column(name)[i].values.to_numpy(zero_copy_only=False) for name in table.column_names}
            side = object.__new__(Side)
            side.size = int(flat.pop("size")[0])
            side.sorted = flat.pop("terms"), flat.pop("begin").astype(np.int64), flat.pop("owner").astype(np.int64), flat.pop("weights")
            side.squares = np.bincount(side.sorted[2], weights=side.sorted[3] * side.sorted[3], minlength=side.size)
            side.columns = {name[1:]: values if len(values) == side.size else values.reshape(side.size, -1) for name, values in flat.items()}
            if added is not None:
                rows = added.take(np.searchsorted(added.column("vec").to_numpy(), side["vec"])).combine_chunks()
                for name in (n for n in rows.column_names if n != "vec"):
                    values = rows.column(name).to_numpy(zero_copy_only=False)
                    side.columns[name] = np.stack(values) if values.dtype == object else values
            out.append(side)
        return out


def stream(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def dot_products(left: Side, right: Side) -> np.ndarray:
    """All dot products of two blocks' rows."""
    out = np.zeros((left.size, right.size))
    one, other = left.by_term(), right.by_term()
    shared, *found = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return out
    sides = []
    for (_, begin, owner, weights), at in zip((one, other), found):
        n = begin[at + 1] - begin[at]
        ends = np.cumsum(n)
        entry = np.repeat(begin[at] - (ends - n), n) + np.arange(int(n.sum()))
        sides.append((np.repeat(np.arange(len(shared)), n), owner[entry], weights[entry], np.append(0, ends)))
    (lt, lr, lw, l_at), (rt, rr, rw, r_at) = sides
    l_n, r_n = np.diff(l_at), np.diff(r_at)
    dense = l_n * r_n > DENSE * left.size * right.size
    heavy = np.flatnonzero(dense)
    column = np.full(len(shared), -1)
    for begin in range(0, len(heavy), COLUMNS):
        some = heavy[begin:begin + COLUMNS]
        column[:] = -1
        column[some] = np.arange(len(some))
        parts = []
        for t, r, w, n in ((lt, lr, lw, left.size), (rt, rr, rw, right.size)):
            inside = column[t] >= 0
            part = np.zeros((n, len(some)))
            part[r[inside], column[t[inside]]] = w[inside]
            parts.append(part)
        out += parts[0] @ parts[1].T
    light = np.flatnonzero(~dense[lt])
    each = r_n[lt[light]]
    ends = np.cumsum(each)
    flat = out.ravel()
    begin = 0
    while begin < len(light):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + max(PRODUCTS, len(flat)), side="right")))
        some, n = light[begin:stop], each[begin:stop]
        partner = np.repeat(r_at[lt[some]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        flat += np.bincount(np.repeat(lr[some], n) * right.size + rr[partner], weights=np.repeat(lw[some], n) * rw[partner], minlength=len(flat))
        begin = stop
    return out


def blocks_for(rows: DataFrame) -> int:
    """Blocks that keep BLOCK and ENTRIES for a frame with terms; smaller ones where there would be fewer pairs of blocks than work for all slots."""
    return _blocks_of(rows, *_counts(rows))


def _counts(rows: DataFrame) -> tuple[int, int]:
    return rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()


def _blocks_of(rows: DataFrame, n: int, entries: int) -> int:
    return max(1, -(-n // BLOCK), -(-entries // ENTRIES), min(-(-n // ROWS), _side_parts(rows)))


def _side_parts(rows: DataFrame) -> int:
    """Partitions of a side whose pairs keep all slots busy."""
    return math.ceil(math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism))


class Blocks(NamedTuple):
    stored: DataFrame  # id, data
    parts: int         # partitions that a side of their pairs may have at most


def blocks_of(rows: DataFrame, pack: Callable[[pa.Table], bytes]) -> Blocks:
    """Stored ``rows`` with terms as blocks of neighbouring rows, of at most BLOCK rows and about ENTRIES entries, packed and stored."""
    n, total = _counts(rows)
    blocks = _blocks_of(rows, n, total)
    most, entries = max(1, -(-n // blocks)), ENTRIES
    dealt = rows.repartition(blocks) if total <= FEW else rows

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held, count, size = [], 0, 0

        def out() -> pa.RecordBatch:
            data = pack(pa.concat_tables(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["id", "size", "data"])

        for batch in batches:
            table, begin = pa.Table.from_batches([batch]), 0
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                stop = min(begin + most - count, int(np.searchsorted(ends, before + entries - size, side="right")), batch.num_rows)
                if stop <= begin and not count:
                    stop = begin + 1  # a row of more entries is a block of its own
                if stop > begin:
                    held.append(table.slice(begin, stop - begin))
                    count, size = count + stop - begin, size + int(ends[stop - 1] - before)
                    begin = stop
                if begin < batch.num_rows or count >= most or size >= entries:
                    yield out()
                    held, count, size, made = [], 0, 0, made + 1
        if count:
            yield out()

    stored = written(dealt.mapInArrow(packing, "id long, size long, data binary"), "blocks")
    size = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return Blocks(stored.drop("size"), max(_side_parts(rows), -(-size // HELD)))


def by_vec(blocks: Blocks, values: DataFrame) -> Blocks:
    """Blocks of ``packed_sides`` with the columns of ``values`` (vec, ...), numbers or lists of one length, beside those that they were packed with.

    ``values`` has all vecs of the blocks. Up to SPREAD bytes of them are broadcast to the blocks; more of them are joined, which moves each block once.
    """
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(batch.column("id")):
                vec = np.concatenate([side["vec"] for side in Side.unpacked(batch.column("data")[i].as_buffer())])
                yield pa.RecordBatch.from_arrays([pa.array(vec), pa.array([key.as_py()] * len(vec))], names=["vec", "id"])

    kind = pa.schema([("id", pa.int64()), ("more", pa.binary()), ("size", pa.int64())])

    def pack(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        data = stream(table.drop_columns(["id"]).combine_chunks())
        return pa.table({"id": [key[0].as_py()], "more": [data], "size": [len(data)]}, schema=kind)

    placed = blocks.stored.mapInArrow(names, "vec long, id long").join(values, "vec")
    more = written(placed.groupBy("id").applyInArrow(pack, "id long, more binary, size long"), "values")
    small = more.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= SPREAD
    more = more.drop("size")
    return Blocks(blocks.stored.join(F.broadcast(more) if small else more, "id"), blocks.parts)


def block_pairs(left: Blocks, right: Blocks, ordered: bool, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over (l_id, l_data, r_id, r_data) of all pairs of blocks; where ``ordered``, of those with l_id <= r_id.

    The product's tasks read the stored blocks; its join hint keeps a side from being broadcast.
    """
    l, r = (b.stored.coalesce(b.parts).select(*(F.col(c).alias(f"{s}_{c}") for c in b.stored.columns)) for s, b in (("l", left), ("r", right)))
    return l.hint("shuffle_replicate_nl").join(r, F.col("l_id") <= F.col("r_id") if ordered else F.lit(True)).mapInArrow(work, schema)


def first_of(k: int, *order: str) -> Callable[[pa.Table], pa.Table]:
    """Keeps the first ``k`` rows of each vec, by ``order``."""
    def keep(table: pa.Table) -> pa.Table:
        vec = table.column("vec").to_numpy()
        by = np.lexsort((*(table.column(c).to_numpy() for c in order[::-1]), vec))
        begin = np.concatenate([[0], np.flatnonzero(np.diff(vec[by])) + 1])
        place = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
        return table.take(pa.array(by[place < k]))

    return keep


def sums(table: pa.Table) -> pa.Table:
    """Adds up all columns for each vec."""
    names = [c for c in table.column_names if c != "vec"]
    return table.group_by("vec").aggregate([(c, "sum") for c in names]).rename_columns({f"{c}_sum": c for c in names}).select(table.column_names)


def _compared(compare: Callable[[Side, Side, np.ndarray], dict[str, np.ndarray]], both: bool, schema: str, keep: Callable[[pa.Table], pa.Table] | None):
    """The work on pairs of blocks that gives all answers, or what ``keep`` leaves of those of a task."""
    kind = _arrow_schema(schema)

    def sides(batch: pa.RecordBatch, name: str, i: int) -> list[Side]:
        return Side.unpacked(*(batch.column(c)[i].as_buffer() for c in (f"{name}_data", f"{name}_more") if c in batch.schema.names))

    def answers(x: Side, y: Side, serves: bool) -> Iterator[pa.Table]:
        dots = dot_products(x, y)
        yield pa.table(compare(x, y, dots)).cast(kind)
        if serves:
            yield pa.table(compare(y, x, np.ascontiguousarray(dots.T))).cast(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left, held, rows, limit = None, [], [], 0, ANSWERS
        for batch in batches:
            ids = zip(batch.column("l_id").to_pylist(), batch.column("r_id").to_pylist())
            for i, (l_id, r_id) in enumerate(ids):
                if l_id != last:
                    last, left = l_id, sides(batch, "l", i)
                own = both and l_id == r_id
                right = left if own else sides(batch, "r", i)
                for at, x in enumerate(left):
                    for y in right[at:] if own else right:
                        for found in answers(x, y, both and x is not y):
                            held.append(found)
                            rows += found.num_rows
                        if rows > limit:
                            if keep is None:
                                yield from pa.concat_tables(held).to_batches(max_chunksize=100_000)
                                held, rows = [], 0
                                continue
                            held = [keep(pa.concat_tables(held).combine_chunks())]
                            rows = held[0].num_rows
                            limit = max(ANSWERS, 2 * rows)
        if held:
            left = pa.concat_tables(held).combine_chunks()
            yield from (left if keep is None else keep(left)).to_batches(max_chunksize=100_000)

    return work


def packed_sides(rows: DataFrame) -> Blocks:
    """Blocks of (vec, terms, weights, other columns) whose parts ``Side.unpacked`` gives back."""
    others = [c for c in rows.columns if c not in ("terms", "weights")]
    return blocks_of(rows, lambda table: Side(table, others).packed())


def meet(asking: DataFrame | Blocks, rows: DataFrame | Blocks, compare: Callable[[Side, Side, np.ndarray], dict[str, np.ndarray]], schema: str,
         keep: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """What ``compare(left, right, dots)`` returns for every part of ``asking`` against every part of ``rows``; a task gives what ``keep`` leaves of it.

    Both (stored frames, or their blocks) hold vec, terms and weights; their other columns reach ``compare`` as arrays. It returns columns of ``schema``.
    """
    asking, rows = (packed_sides(x) if isinstance(x, DataFrame) else x for x in (asking, rows))
    return block_pairs(asking, rows, False, _compared(compare, False, schema, keep), schema)


def meet_all(rows: DataFrame | Blocks, compare: Callable[[Side, Side, np.ndarray], dict[str, np.ndarray]], schema: str,
             keep: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """``meet`` of ``rows`` (or their blocks) with themselves: a pair of blocks meets once, and its dot products serve both directions."""
    packed = packed_sides(rows) if isinstance(rows, DataFrame) else rows
    return block_pairs(packed, packed, True, _compared(compare, True, schema, keep), schema)


def _arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a schema of longs, doubles and lists of doubles."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in schema.split(","))])
