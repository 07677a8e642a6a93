"""SimHash near-duplicates: 64-bit fingerprints of shingles, linked by tiled exact comparison.

Each distinct fingerprint stands once. Tiles hold fingerprints with the same numbers of set bits in each of their four quarters. Two fingerprints at
distance r have quarter counts that differ by at most r in sum, so only pairs of tiles within that distance are compared, each pair by exclusive-or and
bit counts of all its fingerprints; no other pair can link. A tile holds about ``TILE`` fingerprints, so more of one cell make more tiles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.skew import salted_join
from .runtime import prepare, written

WIDTH = 3
RADIUS = 3
SEED = 42
QUARTERS = 4
#: Fingerprints of a tile, and shingles whose bits are counted at once; both only bound memory.
TILE = 2_048
CHUNK = 1 << 16
#: Fingerprint pairs that a task compares at once when it takes several small tile pairs together.
TOGETHER = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    """Unsigned hashes of all ``width``-word shingles of the lower-cased text, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()  # splits bytes at \x20 and \x09-\x0D only
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line, sizes = b" ".join(words), [len(w) + 1 for w in words]
    ends = list(itertools.accumulate(sizes))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b - 1], SEED) for a, b in zip(starts, ends[width - 1:])]


def fingerprint_of(hashes: list[int]) -> int:
    """The bits set in over half of the hashes; 0 without hashes."""
    return int(_majorities([hashes])[0])


def _majorities(lists: list[list[int]]) -> np.ndarray:
    """Fingerprints of several texts' hashes."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    counts = np.zeros((len(lists), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    values = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.uint64, count=int(sizes.sum()))
    for begin in range(0, len(values), CHUNK):
        bits = np.unpackbits(values[begin:begin + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        rows, first = np.unique(owner[begin:begin + CHUNK], return_index=True)
        counts[rows] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    set_ = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, bits) for every row: the 64 bits as a signed long, 0 for null texts and texts without words."""
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _majorities([shingle_hashes(x, width) for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "bits"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, bits long")


def _quarter_counts(bits: str) -> Column:
    """The numbers of set bits of the four quarters in one number, eight binary digits each."""
    size = 64 // QUARTERS
    one = [F.bit_count(F.shiftrightunsigned(F.col(bits), size * q).bitwiseAND((1 << size) - 1)).cast("long") for q in range(QUARTERS)]
    cell = one[0]
    for x in one[1:]:
        cell = cell * 256 + x
    return cell


def _steps(radius: int) -> list[int]:
    """Differences of cells within ``radius``, one of each pair of opposite ones, 0 included."""
    moves = (m for m in itertools.product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, m)) <= radius)
    return [sum(x * 256 ** (QUARTERS - 1 - k) for k, x in enumerate(m)) for m in moves if m >= (0,) * QUARTERS]


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same components as all of (left, right), without cycles."""
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := head.get(x, x)) != x:
            head[x] = x = head.get(up, up)
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = find(a), find(b)
        if x != y:
            head[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _near(left: list[np.ndarray], right: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked fingerprints of the tile pairs (left[i], right[i]), by exclusive-or and bit counts."""
    a_size, b_size = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = np.concatenate(left), np.concatenate(right)
    if len(left) == 1:
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        return a[i], b[j]
    each = np.repeat(b_size, a_size)  # partners of each left fingerprint
    i = np.repeat(np.arange(len(a)), each)
    first = np.repeat(np.cumsum(b_size) - b_size, a_size)
    j = np.arange(len(i)) + np.repeat(first - (np.cumsum(each) - each), each)
    met = np.bitwise_count(a[i] ^ b[j]) <= radius
    return a[i[met]], b[j[met]]


def _compared(radius: int):
    """Tile pairs to links, without repeating what is joined already within a group of pairs compared together."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (0, 1):
                flat = batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sides.append(np.split(flat, np.cumsum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False))[:-1]))
            links: list[tuple[int, int]] = []
            begin, work = 0, 0
            for k in range(batch.num_rows + 1):
                more = len(sides[0][k]) * len(sides[1][k]) if k < batch.num_rows else TOGETHER + 1
                if k > begin and work + more > TOGETHER:
                    a, b = _near(sides[0][begin:k], sides[1][begin:k], radius)
                    other = a != b
                    links += _forest(a[other].view(np.int64), b[other].view(np.int64))
                    begin, work = k, 0
                work += more
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
    return scan


def near_links(bits: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that join the distinct fingerprints of ``bits`` (one column, bits) exactly as all pairs within ``radius`` do."""
    placed = bits.withColumn("cell", _quarter_counts("bits"))
    cells = written(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "cells")
    dealt = placed.join(cells, "cell").withColumn("tile", F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int"))
    tiles = written(dealt.groupBy("cell", "tile").agg(F.collect_list("bits").alias("bits")), "tiles")
    # pairs of tile names first: a tile meets the tiles of its own cell from itself on, and all tiles of the later cells within the radius
    names = tiles.select("cell", "tile", F.explode(F.array(*(F.lit(s).cast("long") for s in _steps(radius)))).alias("step"))
    there = cells.select(F.col("cell").alias("other"), "tiles")
    met = names.join(there, (names["cell"] + names["step"]) == there["other"])
    met = met.select("cell", "tile", "other", F.explode(F.sequence(F.when(F.col("step") == 0, F.col("tile")).otherwise(0), F.col("tiles") - 1)).alias("at"))
    right = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("at"), F.col("bits").alias("b"))
    pairs = met.join(right, ["other", "at"]).join(tiles.withColumnRenamed("bits", "a"), ["cell", "tile"])
    return pairs.select("a", "b").mapInArrow(_compared(radius), "a long, b long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the smallest id reachable. Null and empty texts have the
    fingerprint zero, which is linked like any other. A row without an id has a fingerprint and links others, but its id is never a component; its
    own component is null only where no id is reachable. Repeated rows give repeated results; very long texts are taken whole; a bit set in
    exactly half of the hashes is not set. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    found = written(fingerprints(docs, doc_id, text, width), "fingerprints")
    firsts = written(found.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "firsts")
    links = written(near_links(firsts.select("bits"), radius).distinct(), "links")
    roots = components(links).select(F.col("node").alias("bits"), "root")
    rooted = written(firsts.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    total = found.count()
    classes = salted_join(rooted, least, "root", "members", total, "bits").select("bits", "copies", "component_id")
    out = salted_join(found, written(classes, "classes"), "bits", "copies", total, "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
