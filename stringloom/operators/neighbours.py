"""Similarity self-join of unit vectors, nearest neighbours and the k-th neighbour distance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import unit_distance
from ..plans.scratch import written
from .tiles import ROWS, Blocks, Side, block_pairs, blocks_of, first_of, meet_all, stream

TOLERANCE = 1e-9
SAME = 1e-7  # rounding of the dot product reaches about 4e-8 for parallel vectors
SLACK = 1e-8  # above the rounding of summed squares and of the radius with its tolerance; it only lets more candidates through
BLOCK = 2_000  # rows of one list that meet in one task; it does not grow with the data
DENSE = 0.01  # share of all pairs that meet in listed terms from which on blocks of rows are compared instead of lists joined
PRODUCTS = 1 << 22  # shared listed terms, or entries of candidates, that are looked at together
NO_SHARED_TERM = math.sqrt(2.0)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


@F.arrow_udf(T.DoubleType())
def cosine(terms_a: pa.Array, weights_a: pa.Array, terms_b: pa.Array, weights_b: pa.Array) -> pa.Array:
    """Dot products of sorted sparse rows, a whole batch at a time."""
    ta, la = _flat(terms_a)
    tb, lb = _flat(terms_b)
    wa, wb = _flat(weights_a)[0], _flat(weights_b)[0]
    n = len(la)
    if len(ta) == 0 or len(tb) == 0:
        return pa.array(np.zeros(n))
    return pa.array(_row_dots(ta, la, wa, tb, lb, wb))


def _row_dots(ta: np.ndarray, la: np.ndarray, wa: np.ndarray, tb: np.ndarray, lb: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Dot products of sorted sparse rows, given as flat terms and weights with the rows' lengths."""
    n, width = len(la), int(max(ta.max(), tb.max())) + 1
    keys_a = np.repeat(np.arange(n), la) * width + ta
    row_b = np.repeat(np.arange(n), lb)
    keys_b = row_b * width + tb
    at = np.minimum(np.searchsorted(keys_a, keys_b), len(keys_a) - 1)
    hit = keys_a[at] == keys_b
    return np.bincount(row_b[hit], weights=wa[at[hit]] * wb[hit], minlength=n)


def _rarest(weights: np.ndarray, lengths: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For flat weights of rows with terms: the row of each entry, the squared length after it, which entries are listed, and each row's tail.

    Listed are the rarest terms of a row, while the squared length from there on is >= ``floor``; the tail is the squared length after the last of them.
    """
    owner, squares = np.repeat(np.arange(len(lengths)), lengths), weights * weights
    summed = np.cumsum(squares)
    rest = 1.0 - (summed - np.repeat((summed - squares)[np.cumsum(lengths) - lengths], lengths))
    listed = np.flatnonzero(rest + squares >= floor)
    tail = np.empty(len(lengths))
    tail[owner[listed]] = rest[listed]  # the last one stays
    return owner, rest, listed, tail


def _lists(vectors: DataFrame, floor: float) -> DataFrame:
    """(term, vec, weight, rest, tail): the listed terms of each vector with terms, as ``_rarest`` has them."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                terms, lengths = _flat(batch.column("terms"))
                weights = _flat(batch.column("weights"))[0]
                owner, rest, listed, tail = _rarest(weights, lengths, floor)
                row = owner[listed]
                yield pa.RecordBatch.from_arrays([batch.column("vec").take(pa.array(row)), *map(pa.array, (terms[listed], weights[listed], rest[listed], tail[row]))],
                                                 names=["vec", "term", "weight", "rest", "tail"])

    kinds = {c: vectors.schema[c].dataType for c in ("vec", "terms")}
    schema = f"vec {kinds['vec'].simpleString()}, term {kinds['terms'].elementType.simpleString()}, weight double, rest double, tail double"
    return vectors.select("vec", "terms", "weights").mapInArrow(scan, schema)


def _blocked(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cut long lists into blocks; a row goes to every block pair of its block, so no task holds a whole list."""
    # joined, not broadcast: how many lists are long follows the vocabulary
    long = sizes.where(F.col("n") > BLOCK).select("term", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    marked = lists.join(long, "term", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
    return (
        marked.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("vec", "term", "weight", "rest", "tail", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    )


def _floor(max_dist: float) -> tuple[float, float]:
    """The least cosine within ``max_dist``, and the squared length down to which terms are listed for it."""
    t = 1.0 - max_dist * max_dist / 2.0
    return t, max(t * t - TOLERANCE, t * t / 2)  # never above t * t


def _sized_lists(vectors: DataFrame, max_dist: float) -> tuple[DataFrame, DataFrame]:
    """The lists of vectors with terms, and (term, n) of each list."""
    lists = _lists(vectors.where(F.size("terms") > 0), _floor(max_dist)[1])
    return lists, written(lists.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "lists")


def candidate_pairs(vectors: DataFrame, max_dist: float, listed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(a, b) with a < b: all pairs within ``max_dist`` that share a term, and few others.

    Two vectors with cosine >= t share a term among the rarest terms kept by ``_lists``. All terms that both list up to the end of the shorter list
    meet here, so their products are known; what is shared after the last of them lies behind the end of one of the lists, where it is at most one
    vector's tail times the other's rest (Cauchy-Schwarz). A pair that cannot reach t with that is dropped before any vector is read.
    """
    t, _ = _floor(max_dist)
    lists = written(_blocked(*(listed or _sized_lists(vectors, max_dist))), "postings")
    left, right = lists.alias("l"), lists.alias("r")
    unseen = F.greatest((F.col("l.tail") + SLACK) * (F.col("r.rest") + SLACK), (F.col("r.tail") + SLACK) * (F.col("l.rest") + SLACK))
    shared = (
        left.join(right, (F.col("l.term") == F.col("r.term")) & (F.col("l.p") == F.col("r.p")) & (F.col("l.q") == F.col("r.q"))
                  & (F.col("l.vec") < F.col("r.vec")) & ((F.col("l.p") == F.col("l.q")) | (F.col("l.block") != F.col("r.block"))))
        .select(F.col("l.vec").alias("a"), F.col("r.vec").alias("b"), (F.col("l.weight") * F.col("r.weight")).alias("seen"), unseen.alias("unseen"))
    )
    # the rests fall from term to term, so the least of them stands at the last shared term
    return (
        shared.groupBy("a", "b").agg(F.sum("seen").alias("seen"), F.min("unseen").alias("unseen"))
        .where(F.col("seen") + F.sqrt("unseen") >= t - SLACK).select("a", "b")
    )


class _Listed:
    """Rows of one block with their listed terms in order of terms."""

    def __init__(self, data: pa.Buffer, floor: float):
        table = pa.ipc.open_stream(data).read_all().combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.vec, self.copies = (column(c).to_numpy(zero_copy_only=False) for c in ("vec", "copies"))
        self.terms, self.lengths = _flat(column("terms"))
        self.weights, self.size = _flat(column("weights"))[0], table.num_rows
        self.begin = np.cumsum(self.lengths) - self.lengths
        owner, rest, listed, self.tail = _rarest(self.weights, self.lengths, floor)
        by = listed[np.argsort(self.terms[listed], kind="stable")]
        self.owner, self.weight, self.rest = owner[by], self.weights[by], rest[by]
        self.listed, at = np.unique(self.terms[by], return_index=True)
        self.at = np.append(at, len(by))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.lengths[rows]
        flat = np.repeat(self.begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.terms[flat], n, self.weights[flat]


def _candidates(x: _Listed, y: _Listed, t: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y that ``candidate_pairs`` would let through, for some rows of x at a time."""
    _, mine, theirs = np.intersect1d(x.listed, y.listed, assume_unique=True, return_indices=True)
    n = x.at[mine + 1] - x.at[mine]
    left = np.repeat(x.at[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))  # entries of x in shared terms, and where y's are
    low, each = np.repeat(y.at[theirs], n), np.repeat(y.at[theirs + 1] - y.at[theirs], n)
    part = x.owner[left] // ROWS
    for k in np.unique(part):
        some = part == k
        l, y_at, times = left[some], low[some], each[some]
        seen, unseen = np.zeros(ROWS * y.size), np.empty(ROWS * y.size, np.float32)
        ends, begin = np.cumsum(times), 0
        while begin < len(l):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PRODUCTS, side="right")))
            m = times[begin:stop]
            a, b = np.repeat(l[begin:stop], m), np.repeat(y_at[begin:stop] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            i, j = x.owner[a], y.owner[b]
            at = (i - k * ROWS) * y.size + j
            seen += np.bincount(at, weights=x.weight[a] * y.weight[b], minlength=len(seen))
            # terms come in order, so the value of the last shared one stays
            unseen[at] = np.maximum((x.tail[i] + SLACK) * (y.rest[b] + SLACK), (y.tail[j] + SLACK) * (x.rest[a] + SLACK))
            begin = stop
        met = np.flatnonzero(seen)
        met = met[seen[met] + np.sqrt(unseen[met].astype(float) * (1 + 1e-6)) >= t - SLACK]  # above the rounding of the short numbers
        i, j = met // y.size + k * ROWS, met % y.size
        if own:
            i, j = i[i < j], j[i < j]
        yield i, j


def _pairs_by_blocks(vectors: DataFrame, max_dist: float) -> DataFrame:
    """``close_pairs`` of vectors with terms, from pairs of stored blocks: only pairs within ``max_dist`` leave a task."""
    (t, floor), kind = _floor(max_dist), vectors.schema["vec"].dataType.simpleString()
    blocks = blocks_of(vectors.select("vec", "copies", "terms", "weights"), lambda table: stream(table))

    def compare(x: _Listed, y: _Listed, own: bool) -> Iterator[pa.RecordBatch]:
        for left, right in _candidates(x, y, t, own):
            ends, begin = np.cumsum(x.lengths[left] + y.lengths[right]), 0
            while begin < len(left):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PRODUCTS, side="right")))
                i, j = left[begin:stop], right[begin:stop]
                dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * _row_dots(*x.entries(i), *y.entries(j))))
                near = dist <= max_dist + TOLERANCE
                i, j, dist = i[near], j[near], np.where(dist[near] < SAME, 0.0, dist[near])
                first = x.vec[i] < y.vec[j]
                pick = lambda one, other: pa.array(np.where(first, one, other))
                yield pa.RecordBatch.from_arrays([pick(x.vec[i], y.vec[j]), pick(y.vec[j], x.vec[i]), pa.array(dist), pick(x.copies[i], y.copies[j]),
                                                  pick(y.copies[j], x.copies[i])], names=["a", "b", "dist", "copies_a", "copies_b"])
                begin = stop

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            side = lambda name, i: _Listed(batch.column(name)[i].as_buffer(), floor)  # noqa: E731, B023
            for i, (l_id, r_id) in enumerate(zip(batch.column("l_id").to_pylist(), batch.column("r_id").to_pylist())):
                if l_id != last:
                    last, left = l_id, side("l_data", i)
                yield from compare(left, left if l_id == r_id else side("r_data", i), l_id == r_id)

    return block_pairs(blocks, blocks, True, work, f"a {kind}, b {kind}, dist double, copies_a long, copies_b long")


def close_pairs(vectors: DataFrame, max_dist: float) -> DataFrame:
    """(a, b, dist, copies_a, copies_b) with a < b and dist <= max_dist, for (vec, copies, terms, weights).

    Exact: the candidates lose none, and the whole vectors of a candidate give its distance. They come from joined lists of rare terms; where so many
    pairs meet in these lists that their rows would be more than the vectors are, stored blocks of vectors are compared instead, with the same bounds.
    ``max_dist`` must stay below sqrt(2), the distance of vectors that share nothing.
    """
    if not 0 <= max_dist < NO_SHARED_TERM:
        raise ValueError("max_dist must be in [0, sqrt(2)): beyond it every pair of rows is a neighbour")
    worded = vectors.where(F.size("terms") > 0)
    listed = _sized_lists(vectors, max_dist)
    met = listed[1].agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1.0) / 2), F.lit(0.0))).first()[0]
    if met > DENSE * worded.count() ** 2 / 2:
        pairs = _pairs_by_blocks(worded, max_dist)
    else:
        side = {s: vectors.select(F.col("vec").alias(s), F.col("copies").alias(f"copies_{s}"), F.col("terms").alias(f"t_{s}"),
                                  F.col("weights").alias(f"w_{s}")) for s in "ab"}
        pairs = (
            candidate_pairs(vectors, max_dist, listed).join(side["a"], "a").join(side["b"], "b")
            .select("a", "b", unit_distance(cosine("t_a", "w_a", "t_b", "w_b")).alias("dist"), "copies_a", "copies_b")
            .where(F.col("dist") <= max_dist + TOLERANCE)
            .withColumn("dist", F.when(F.col("dist") < SAME, 0.0).otherwise(F.col("dist")))
        )
    if max_dist + TOLERANCE >= 1.0:
        # the wordless rows are one collapsed vector, at distance 1 from every other
        blank = vectors.where(F.size("terms") == 0).select("vec", "copies").first()
        if blank is not None:
            mine, other = F.lit(blank["vec"]), F.col("vec")
            star = vectors.where(F.size("terms") > 0).select(
                F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b"), F.lit(1.0).alias("dist"),
                F.when(mine < other, F.lit(blank["copies"])).otherwise(F.col("copies")).alias("copies_a"),
                F.when(mine < other, F.col("copies")).otherwise(F.lit(blank["copies"])).alias("copies_b"))
            pairs = pairs.unionByName(star)
    return pairs


def both_ways(pairs: DataFrame) -> DataFrame:
    """(vec, nbr, dist, nbr_copies) in both directions."""
    forth = pairs.select(F.col("a").alias("vec"), F.col("b").alias("nbr"), "dist", F.col("copies_b").alias("nbr_copies"))
    back = pairs.select(F.col("b").alias("vec"), F.col("a").alias("nbr"), "dist", F.col("copies_a").alias("nbr_copies"))
    return forth.unionByName(back)


def _ranked(row: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """Positions of the first ``k`` entries of each row, by ``order`` (first key first)."""
    by = np.lexsort((*order[::-1], row))
    begin = np.concatenate([[0], np.flatnonzero(np.diff(row[by])) + 1]) if len(by) else by
    place = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
    return by[place < k]


def smallest(values: np.ndarray, k: int, order: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` smallest finite values of each row of a matrix; ``order(row, column)`` breaks ties."""
    at = min(k, values.shape[1]) - 1
    row, column = np.nonzero((values <= np.partition(values, at, axis=1)[:, at:at + 1]) & np.isfinite(values))
    kept = _ranked(row, k, values[row, column], *order(row, column))
    return row[kept], column[kept]


def tile_distances(left: Side, right: Side, dots: np.ndarray) -> np.ndarray:
    """Distances of two blocks' rows; infinite between a row and itself."""
    out = np.sqrt(np.maximum(0.0, left.squares[:, None] + right.squares[None, :] - 2 * dots))
    out[out < SAME] = 0.0
    out[left["vec"][:, None] == right["vec"][None, :]] = np.inf
    return out


def nearest_rows(vectors: DataFrame | Blocks, k: int) -> DataFrame:
    """(vec, nbr, dist, nbr_copies): the ``k`` nearest vectors of each one (or of their blocks, with copies), ties to the smaller id, whatever their distance.

    Exact, without a radius: tasks keep the ``k`` nearest of each row, and the tasks' answers meet by a ranked window.
    """
    def compare(left: Side, right: Side, dots: np.ndarray) -> dict[str, np.ndarray]:
        d = tile_distances(left, right, dots)
        row, column = smallest(d, k, lambda _, c: (right["vec"][c],))
        return {"vec": left["vec"][row], "nbr": right["vec"][column], "dist": d[row, column], "nbr_copies": right["copies"][column]}

    side = vectors if isinstance(vectors, Blocks) else vectors.select("vec", "copies", "terms", "weights")
    found = meet_all(side, compare, "vec long, nbr long, dist double, nbr_copies long", first_of(k, "dist", "nbr"))
    nearest = Window.partitionBy("vec").orderBy("dist", "nbr")
    return found.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k).drop("at")


def core_distances(vectors: DataFrame, nbrs: DataFrame, min_samples: int) -> DataFrame:
    """(vec, copies, core): distance to the ``min_samples``-th row, the row itself and its copies counted.

    ``nbrs`` are directed (vec, nbr, dist, nbr_copies); NULL where they hold too few rows. Only the nearest ``min_samples`` neighbours of a vector
    matter; the row-number limit is applied before the shuffle, so hubs stay cheap.
    """
    nearest = Window.partitionBy("vec").orderBy("dist", "nbr")
    ranked = (
        nbrs.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= min_samples)
        .withColumn("rows", F.sum("nbr_copies").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
        .select("vec", "dist", "rows")
    )
    reached = vectors.select("vec", "copies").join(ranked, "vec", "left").groupBy("vec", "copies").agg(
        F.min(F.when(F.col("copies") + F.col("rows") >= min_samples, F.col("dist"))).alias("far"))
    return reached.select("vec", "copies", F.when(F.col("copies") >= min_samples, 0.0).otherwise(F.col("far")).alias("core"))
