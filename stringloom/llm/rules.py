"""Quality rules judged by an isolation forest over rule statistics.

Every text gives a row of rule statistics. Random splits isolate odd rows in few steps (Liu et al. 2008); the limit on the
path length comes from all labelled rows: it is the one that tells label 0 from label 1 best among those that reject at most a
stated share of the label-1 rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import with_position
from .runtime import prepare, written
from .words import Words, signed, window_hashes

#: Counts of the base rules, then the ratios that the forest splits on.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("log_words", "word_length", "symbol_share", "duplicate_lines", "repeat_share", "upper_share", "digit_share", "mark_share",
          "adjacent_share", "common_share", "shout_share", "bar_share")
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
#: Trees of the forest, rows of each, the share of label-1 rows that the limit may reject, and the seed of the draws.
TREES, LEAF, REJECT, SEED = 200, 64, 0.005, 5

_LEAD = np.zeros(256, dtype=np.int64)
_LEAD[:0x80] = 1
_LEAD[0xC0:] = 1  # a code point counts at its first byte
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words covered by a window of ``width`` words that occurs at least twice in the text."""
    if len(hashes) <= width:
        return 0
    windows = window_hashes(hashes, width)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hits = np.flatnonzero(np.isin(windows, twice))
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, hits, 1)
    np.add.at(change, hits + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word equal to an earlier line, and all lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts and the ratio matrix (rows x RATIOS) of a text column; a null text counts as empty."""
    words = Words(column)
    hashes = words.hashes()
    n = words.counts()
    chars = _sums(_LEAD[words.data], words.offsets)
    lead = np.concatenate(([0], np.cumsum(_LEAD[words.data])))
    size = lead[words.ends] - lead[words.starts] if len(words) else np.zeros(0, np.int64)
    upper = np.concatenate(([0], np.cumsum(_UPPER[words.data])))
    capitals = upper[words.ends] - upper[words.starts] if len(words) else np.zeros(0, np.int64)
    shouted = (capitals >= 2) & (2 * capitals > size)
    bars = (words.ends - words.starts == 1) & (_MARK[words.data[words.starts]] == 1) if len(words) else np.zeros(0, bool)
    word_chars = _sums(size, words.first)
    repeats, duplicated, lines = (np.zeros(words.rows, dtype=np.int64) for _ in range(3))
    common, adjacent = np.zeros(words.rows), np.zeros(words.rows)
    texts = column.to_pylist()
    for r in range(words.rows):
        own = hashes[words.first[r]:words.first[r + 1]]
        repeats[r] = repeated_words(own)
        duplicated[r], lines[r] = duplicate_lines(texts[r] or "")
        if len(own):
            common[r] = np.unique(own, return_counts=True)[1].max() / len(own)
            adjacent[r] = (own[1:] == own[:-1]).mean() if len(own) > 1 else 0.0
    base = {"n_words": n, "word_chars": word_chars, "n_symbols": _sums(_SYMBOL[words.data], words.offsets),
            "n_dup_lines": duplicated, "n_repeat_words": repeats}
    per_word, per_char = np.maximum(n, 1), np.maximum(chars, 1)
    ratios = np.stack([
        np.log1p(n), word_chars / per_word, base["n_symbols"] / per_char, duplicated / np.maximum(lines, 1), repeats / per_word,
        _sums(_UPPER[words.data], words.offsets) / per_char, _sums(_DIGIT[words.data], words.offsets) / per_char,
        _sums(_MARK[words.data], words.offsets) / per_char, adjacent, common, _sums(shouted.astype(np.int64), words.first) / per_word,
        _sums(bars.astype(np.int64), words.first) / per_word], axis=1)
    return base, ratios


def rule_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the five counts, ratios array) for every row, from its whole text.

    Null and empty texts give zeros. Repeated rows give repeated results; other columns are ignored whatever their names.
    """
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, ratios = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(base[c], pa.int64()) for c in COUNTS), pa.array(list(ratios), pa.list_(pa.float64()))],
                names=["doc_id", *COUNTS, "ratios"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", ratios array<double>")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass
class Forest:
    """Trees as flat arrays: split column (-1 at a leaf), split value, children and the length credited at a leaf."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    leaf_size: int = 256
    limit: float = 1.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for rows that random splits isolate at once."""
        if not len(rows) or not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for column, value, left, right, length in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                split = column[at]
                inner = split >= 0
                if not inner.any():
                    break
                low = rows[np.arange(len(rows)), np.maximum(split, 0)] < value[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / expected_length(self.leaf_size))


def expected_length(n: int) -> float:
    """Mean path of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grown_tree(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    height = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[list[float]] = []

    def grow(own: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + expected_length(len(own))])
        spread = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if len(own) > 1 and depth < height else []
        if len(spread):
            c = int(rng.choice(spread))
            v = rng.uniform(own[:, c].min(), own[:, c].max())
            low = own[:, c] < v
            nodes[here][:2] = [c, v]
            nodes[here][2] = grow(own[low], depth + 1)
            nodes[here][3] = grow(own[~low], depth + 1)
        return here

    grow(rows, 0)
    table = np.array(nodes)
    return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]


def fit_forest(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, leaf_size: int = LEAF, reject_at_most: float = REJECT,
               seed: int = SEED) -> Forest:
    """Forest over ``rows``, each tree on ``leaf_size`` of them; the limit is calibrated on the labels (1 good, 0 bad).

    Without both labels nothing but the base rules rejects.
    """
    if not len(rows):
        return Forest(leaf_size=leaf_size)
    rng = np.random.default_rng(seed)
    size = min(leaf_size, len(rows))
    forest = Forest([grown_tree(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)], size)
    if (labels == 0).any() and (labels == 1).any():
        scores = forest.scores(rows)
        kept, bad = scores[labels == 1], scores[labels == 0]
        floor = np.quantile(kept, 1 - reject_at_most, method="higher")
        ranked = np.unique(np.concatenate([bad[bad > floor], [floor]]))
        gain = [(bad > x).mean() - 10 * (kept > x).mean() for x in ranked]
        forest.limit = float(ranked[int(np.argmax(gain))]) if max(gain) > 0 else 1.0
    return forest


def _marked(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the label rows that hold 0 or 1."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return marked.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, where: Column | None = None,
                    even: bool = True) -> DataFrame:
    """At most about ``bound`` labelled rows (doc_id, text, label), chosen by a hash of the id.

    ``even`` splits them over the two label values, otherwise the values keep their shares. The share taken follows from the counts,
    so the expected size is at most ``bound`` at any scale; the sample is the same on every run.
    """
    marked = _marked(labels, label)
    if where is not None:
        marked = marked.where(where)
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, bound / 2 / n if even else bound / sum(counts.values()))
        wanted = wanted | ((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))))
    # the expected number of rows is at most `bound`; the second limit only makes that a proof
    chosen = marked.where(wanted).orderBy(F.xxhash64("doc_id")).limit(2 * bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id")


def _calibrated(scored: DataFrame, reject_at_most: float = REJECT) -> float:
    """The limit that ``fit_forest`` finds, over (doc_id, score, label) of any size: ranks and running counts stay in tables."""
    sizes = {r["label"]: r["n"] for r in scored.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return 1.0
    at = math.ceil((sizes[1] - 1) * (1 - reject_at_most))
    floor = with_position(scored.where("label = 1").select("score", "doc_id"), ["score", "doc_id"]).where(F.col("position") == at).first()["score"]
    high = scored.where(F.col("score") >= floor).groupBy("score").agg(F.count_if(F.col("label") == 1).alias("kept"), F.count_if(F.col("label") == 0).alias("bad"))
    high = written(high.repartitionByRange("score").withColumn("slice", F.spark_partition_id()), "high")
    later = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)  # over one row for each slice
    above = high.groupBy("slice").agg(F.sum("kept").alias("k"), F.sum("bad").alias("b")).select(
        "slice", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in "kb"))
    inside = Window.partitionBy("slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    more = lambda own, rest: F.coalesce(F.sum(own).over(inside), F.lit(0)) + F.col(rest)
    gain = more("bad", "b") / F.lit(sizes[0]) - 10 * (more("kept", "k") / F.lit(sizes[1]))
    gains = high.join(F.broadcast(above), "slice").withColumn("gain", gain).where((F.col("bad") > 0) | (F.col("score") == floor))
    best = gains.orderBy(F.desc("gain"), "score").first()
    return best["score"] if best["gain"] > 0 else 1.0


def fitted_forest(docs: DataFrame, labels: DataFrame, bound: int = 6_000) -> Forest:
    """Forest fitted on all labelled rows.

    Up to ``bound`` rows are fitted on the driver. Of more rows, each tree draws its few from all of them, so only these reach the driver, and the
    limit is calibrated on the scores of all by tables.
    """
    marked = _marked(labels, "quality").groupBy("doc_id").agg(F.min("label").alias("label"))
    each = rule_statistics(docs).select("doc_id", base_failed().alias("failed"), "ratios").join(marked, "doc_id")
    # rows that share an id count once
    once = each.groupBy("doc_id", "label").agg(F.min(F.struct("failed", "ratios")).alias("r"))
    rows = written(once.where(~F.col("r.failed")).select("doc_id", "label", "r.ratios"), "labelled")
    total = rows.count()
    if total <= bound:
        got = rows.orderBy("doc_id").toArrow()
        return fit_forest(_matrix(got.column("ratios")), got.column("label").to_numpy().astype(int))
    rng = np.random.default_rng(SEED)
    size = min(LEAF, total)
    drawn = [rng.choice(total, size, replace=False) for _ in range(TREES)]
    places = np.unique(np.concatenate(drawn))
    wanted = docs.sparkSession.createDataFrame(pa.table({"position": places}))
    got = with_position(rows.select("doc_id", "ratios"), ["doc_id"]).join(F.broadcast(wanted), "position").orderBy("position").toArrow()
    values = _matrix(got.column("ratios"))
    forest = Forest([grown_tree(values[np.searchsorted(places, own)], rng) for own in drawn], size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(_matrix(batch.column(2)))), batch.column(1)], names=["doc_id", "score", "label"])

    forest.limit = _calibrated(written(rows.mapInArrow(score, "doc_id long, score double, label int"), "scored"))
    return forest


def _matrix(ratios: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows x RATIOS of a list column."""
    return np.array(ratios.to_pylist(), dtype=float).reshape(-1, len(RATIOS))


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, five counts, base_failed, anomaly, kept) for every row."""
    prepare(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, ratios = statistics(batch.column(1))
            got = forest.scores(ratios)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(base[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(got),
                 pa.array(~failed & (got <= forest.limit))], names=["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, bound: int = 6_000) -> DataFrame:
    """Verdict of the rules on every row of ``docs``; see ``judged`` for the columns.

    Null and empty texts fail the base rules (no words). Rows that share an id are judged each on its own text.
    """
    return judged(docs, fitted_forest(docs, labels, bound))


def passing(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names and number."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, ratios = statistics(batch.column(place).cast(pa.string()))
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
            yield batch.filter(pa.array(~failed & (forest.scores(ratios) <= forest.limit)))

    return docs.mapInArrow(keep, docs.schema)
