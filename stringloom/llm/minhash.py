"""Near-duplicate groups by bottom-k sketches from one hash function.

Every document keeps the k smallest hashes of its distinct word shingles. Inverted lists of retained values give candidate pairs, the
union of two sketches estimates their Jaccard similarity and drops hopeless ones, and full shingle sets decide the rest.

- Equal sets are one node from the start, so a group of copies costs one sketch.
- A list key is a run of ``RUN`` neighbouring retained values; sets of at most ``LIMIT`` shingles are listed under each value of their prefix
  instead (n - ceil(t n) + 1 smallest values), which is exact. With k = 48 and t = 0.75 a pair of larger sets that just reaches the
  threshold shares no run of three with probability below 2e-7, and the estimate is allowed five standard deviations.
- In each list all members are compared with one hub, never with each other. Only where a hub's lists then still span several components do the
  documents outside the hub's component meet the others: by a join for small hubs, else in blocks inside tasks that compare full sets and
  return one link for each pair of components joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .runtime import fresh_names, prepare, written
from .words import Words, mixed, sequence_hash, signed, window_hashes

WIDTH = 5
THRESHOLD = 0.75
SKETCH = 48
RUN = 3
#: A hub with up to this many documents has the rest of its lists compared by a join; beyond, its documents meet in blocks of ``BLOCK``, by
#: exact set sizes over ``COLUMNS`` shingles at a time.
SMALL = 128
BLOCK = 512
COLUMNS = 4_096


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a text without words has none."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    if len(words) < width:
        return signed(np.array([sequence_hash(words)], dtype=np.uint64))
    return np.unique(signed(window_hashes(words, width)))


def _sketches(width: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1), lower=True)
            hashes = words.hashes()
            sizes, left, right, kept = [], [], [], []
            for r in range(words.rows):
                own = shingle_set(hashes[words.first[r]:words.first[r + 1]], width)
                sizes.append(len(own))
                bits = own.view(np.uint64)
                left.append(int(signed(mixed(bits + np.uint64(0x51ED27)).sum(dtype=np.uint64, keepdims=True))[0]))
                right.append(int(signed((mixed(bits ^ np.uint64(0xABCD1234F)) * np.uint64(3)).sum(dtype=np.uint64, keepdims=True))[0]))
                kept.append(own[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64()),
                 pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "left", "right", "sketch"])
    return scan


def _list_keys(threshold: float, k: int) -> Column:
    """Keys of the inverted lists that a sketch stands in."""
    n, s = F.col("n_shingles"), F.col("sketch")
    prefix = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    single = F.transform(F.slice(s, F.lit(1), prefix), lambda v: F.xxhash64(F.lit(1), v))
    runs = F.transform(F.sequence(F.lit(1), F.size(s) - (RUN - 1)),
                       lambda i: F.xxhash64(F.lit(RUN), *(F.element_at(s, (i + j).cast("int")) for j in range(RUN))))
    none = F.array().cast("array<bigint>")
    return F.concat(F.when(n <= int(k / threshold), single).otherwise(none), F.when(n >= k, runs).otherwise(none))


def _estimate_passes(threshold: float, k: int) -> Column:
    """Union-sketch estimate of the similarity of sketches ``sa`` and ``sb``, within five standard deviations of the threshold."""
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    slack = 5 * math.sqrt(threshold * (1 - threshold) / k)
    whole = (F.col("na") <= k) & (F.col("nb") <= k) & (F.size(F.array_union("sa", "sb")) <= k)
    return both >= F.size(union) * F.when(whole, F.lit(threshold - 1e-9)).otherwise(F.lit(threshold - slack))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold, compared as whole numbers of hundredths."""
    hundredths = round(100 * threshold)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            right = Words(batch.column(3), lower=True)
            hashes = right.hashes()
            good = []
            for r, node in enumerate(a):
                if node != last:
                    one = Words(batch.column(2).slice(r, 1), lower=True)
                    last, known = node, shingle_set(one.hashes(), width)
                other = shingle_set(hashes[right.first[r]:right.first[r + 1]], width)
                shared = len(np.intersect1d(known, other, assume_unique=True))
                good.append(100 * shared >= hundredths * (len(known) + len(other) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    # the hub is side a: its text is met last, when the other texts already stand beside their pairs
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    side = lambda x: nodes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n" + x), F.col("sketch").alias("s" + x))
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.where(100 * low >= round(100 * threshold) * high).where(_estimate_passes(threshold, k)).select("a", "b")


def _sets(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1), lower=True)
            hashes = words.hashes()
            own = [shingle_set(hashes[words.first[r]:words.first[r + 1]], width) for r in range(words.rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "shingles"])
    return scan


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all left with all right sets, by blocks of the values that both sides have."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    (lv, lr), (rv, rr) = flat(left), flat(right)
    common = np.intersect1d(lv, rv)
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, len(common), COLUMNS):
        values = common[begin:begin + COLUMNS]
        sides = []
        for v, r, n in ((lv, lr, len(left)), (rv, rr, len(right))):
            at = np.minimum(np.searchsorted(values, v), len(values) - 1)
            met = values[at] == v
            marks = np.zeros((n, len(values)), dtype=np.float32)
            marks[r[met], at[met]] = 1
            sides.append(marks)
        shared += sides[0] @ sides[1].T
    return shared


def _block_links(threshold: float):
    """Exact links between two blocks of one hub's documents, one for each pair of components that they join."""
    hundredths = round(100 * threshold)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            shared = _shared_counts(left["shingles"].tolist(), right["shingles"].tolist())
            sizes = left["n_shingles"].to_numpy()[:, None] + right["n_shingles"].to_numpy()[None, :]
            roots = left["root"].to_numpy(), right["root"].to_numpy()
            i, j = np.nonzero((100 * shared >= hundredths * (sizes - shared)) & (roots[0][:, None] != roots[1][None, :]))
            _, first = np.unique(np.stack([roots[0][i], roots[1][j]]), axis=1, return_index=True)
            head: dict[int, int] = {}

            def find(x: int) -> int:
                while head.get(x, x) != x:
                    x = head[x]
                return x

            for k in first.tolist():
                x, y = find(int(roots[0][i[k]])), find(int(roots[1][j[k]]))
                if x != y:
                    head[max(x, y)] = min(x, y)
                    out.append((int(left["doc_id"].iloc[i[k]]), int(right["doc_id"].iloc[j[k]])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return compare


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD,
                    k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents whose sets of distinct ``width``-word shingles have a Jaccard similarity of at least ``threshold`` are linked;
    ``component_id`` is the smallest id reachable and ``kept`` marks that document. Null and empty texts have no shingles and are linked
    with nothing. Rows with equal texts are linked whatever their ids; repeated rows of one id are all kept or all dropped. A row without
    an id is never linked and stays (component null). Other columns are ignored whatever their names. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, left long, right long, sketch array<long>"
    sets = written(rows.mapInArrow(_sketches(width, k), schema), "sketches")

    named = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    same = ["n_shingles", "left", "right"]
    firsts = named.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    firsts = written(firsts, "firsts")
    nodes = (sets.join(firsts.select(*same, F.col("node").alias("doc_id")), [*same, "doc_id"]).select("doc_id", "n_shingles", "sketch")
             .dropDuplicates(["doc_id"]))
    nodes = written(nodes, "nodes")

    postings = nodes.select("doc_id", F.explode(_list_keys(threshold, k)).alias("key"))
    lists = (postings.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = written(postings.join(lists, "key"), "lists")
    pairs = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    texts = rows.join(firsts.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    texts = texts.where(F.col("doc_id").isNotNull())
    links = written(_verified(_estimated(pairs, nodes, threshold, k), texts, width, threshold).distinct(), "links")
    roots = written(components(links), "roots")

    # hubs whose lists still span several components: there the documents outside the hub's component meet all others
    known = roots.withColumnRenamed("node", "doc_id")
    met = members.where("n > 2").join(known, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    of_hub = met.select("hub", "doc_id", "root").distinct()
    stray = of_hub.join(of_hub.where("doc_id = hub").select("hub", F.col("root").alias("own")), "hub").withColumn("stray", F.col("root") != F.col("own"))
    stray = written(stray.drop("own"), "strays")
    open_hubs = written(stray.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("stray").cast("int")).alias("strays")).where("strays > 0"), "open")

    short = met.join(open_hubs.where(F.col("size") <= SMALL).select("hub"), "hub").join(nodes.select("doc_id", "n_shingles"), "doc_id")
    short = short.select("key", "doc_id", "root", "hub", "n_shingles")
    other = short.select("key", *(F.col(c).alias("o_" + c) for c in ("doc_id", "root", "n_shingles")))
    low, high = F.least("n_shingles", "o_n_shingles"), F.greatest("n_shingles", "o_n_shingles")
    near = (short.join(other, "key").where("doc_id < o_doc_id AND root <> o_root AND doc_id <> hub")
            .where(100 * low >= round(100 * threshold) * high).select(F.col("doc_id").alias("a"), F.col("o_doc_id").alias("b")).distinct())
    found = _verified(_estimated(near, nodes, threshold, k), texts, width, threshold)

    long = stray.join(open_hubs.where(F.col("size") > SMALL), "hub")
    asked = long.select("doc_id").distinct()
    sets_of = texts.join(asked, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(width), "doc_id long, shingles array<long>")
    rows_of = long.join(nodes.select("doc_id", "n_shingles"), "doc_id").join(written(sets_of, "sets"), "doc_id")
    blocks = {0: F.ceil(F.col("strays") / BLOCK).cast("int"), 1: F.ceil(F.col("size") / BLOCK).cast("int")}
    own = lambda side: F.pmod(F.xxhash64("doc_id", F.lit(side)), blocks[side]).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), blocks[side] - 1))
    dealt = (rows_of.where("stray").withColumn("x", own(0)).withColumn("y", every(1)).withColumn("side", F.lit(0))
             .unionByName(rows_of.withColumn("y", own(1)).withColumn("x", every(0)).withColumn("side", F.lit(1))))
    far = (dealt.select("hub", "x", "y", "side", "doc_id", "root", "n_shingles", "shingles").groupBy("hub", "x", "y")
           .applyInPandas(_block_links(threshold), "a long, b long"))

    late = written(links.unionByName(found).unionByName(far).distinct(), "links")
    roots = written(components(late), "roots")

    answer = firsts.join(roots, "node", "left").select(*same, F.coalesce("root", "node").alias("component"))
    linked = sets.drop("sketch").join(answer, same, "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept whatever their names.

    Rows that repeat both id and text count as one document; rows without an id stay. Null and empty texts are near nothing, very long ones are
    compared whole, an empty table gives no rows.
    """
    gone, text_hash = fresh_names(docs, "dropped_id", "text_hash")
    own = F.col(f"`{doc_id}`")
    dropped = near_duplicates(docs, doc_id, text).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    left = docs.where(own.isNotNull()).join(dropped, own.cast("long") == F.col(gone), "left_anti")
    once = left.withColumn(text_hash, F.xxhash64(F.col(f"`{text}`"))).dropDuplicates([doc_id, text_hash]).drop(text_hash)
    return once.unionByName(docs.where(own.isNull()))
