"""Quality scores by nearest-neighbour voting among latent-semantic vectors of labelled documents.

Terms are words, hashed to ``WORDS`` columns, and beside them how a text is written: n-grams of character kinds and ratios of repetition. Both parts are weighed
by TF-IDF and have unit length before they stand side by side. Latent vectors come from the leading singular vectors of the labelled rows' matrix, found by a
randomised product. The labelled vectors are a small broadcast; every document is compared with all of them by exact cosine products, block by block, and its
nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import KINDS, fold_of, gram_counts, unit_rows
from .rules import RATIOS, labelled_sample, statistics
from .runtime import prepare
from .words import Words

#: Columns of hashed words and of hashed n-grams of character kinds.
WORDS = 1 << 16
BUCKETS = 1_024
DIMENSIONS = 64
NEIGHBOURS = 15
#: At most about so many labelled rows are fitted on; their vectors are what is broadcast, their terms (at most TERMS a row) what reaches the driver.
LABELLED = 5_000
#: Rule ratios that count as terms too, and their weight next to an n-gram.
REPETITION = [RATIOS.index(c) for c in ("symbol_share", "duplicate_lines", "repeat_share", "adjacent_share", "common_share", "shout_share", "bar_share")]
REPETITION_WEIGHT = 2.0
MANNER = BUCKETS + len(REPETITION)
TERMS = MANNER + WORDS
#: Length of the word part next to that of the other part.
WORD_WEIGHT = 0.5
#: Entries multiplied at once; bounds the memory of a product, not what is multiplied.
ENTRIES = 200_000


@dataclass
class Terms:
    """Terms of rows. Row ``r`` has the entries ``first[r]:first[r + 1]`` of (column, value), columns ascending."""

    first: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def document_counts(self) -> np.ndarray:
        return np.bincount(self.columns[self.values > 0], minlength=TERMS)

    def weighed(self, weight: np.ndarray) -> Terms:
        """TF-IDF with each part of a row at its own length."""
        values, row, word = self.values * weight[self.columns], self.rows(), self.columns >= MANNER
        for part, length in ((~word, 1.0), (word, WORD_WEIGHT)):
            size = np.sqrt(np.bincount(row[part], weights=values[part] ** 2, minlength=len(self)))
            values[part] *= length / np.where(size > 0, size, 1)[row[part]]
        return Terms(self.first, self.columns, values.astype(np.float32))

    def times(self, dense: np.ndarray) -> np.ndarray:
        """Product with a TERMS x k matrix."""
        return _sums(self.first, self.columns, self.values, dense)

    def turned(self) -> Terms:
        """The transposed matrix: a row for each term, rows as columns."""
        order = np.argsort(self.columns, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=TERMS))])
        return Terms(first, self.rows()[order], self.values[order])


def _sums(first: np.ndarray, columns: np.ndarray, values: np.ndarray, dense: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, dense.shape[1]), dtype=np.float32)
    row = np.repeat(np.arange(len(out)), np.diff(first))
    for begin in range(0, len(columns), ENTRIES):
        part = slice(begin, min(begin + ENTRIES, len(columns)))
        here, start = np.unique(row[part], return_index=True)
        out[here] += np.add.reduceat(dense[columns[part]] * values[part, None], start, axis=0)
    return out


def term_matrix(column: pa.Array) -> Terms:
    """Log frequencies of the terms of each text."""
    grams = gram_counts(Words(column), KINDS, (2, 3), BUCKETS)
    rates = np.log1p(1000 * grams / np.maximum(grams.sum(axis=1, keepdims=True), 1))
    _, ratios = statistics(column)
    manner = np.concatenate([rates, REPETITION_WEIGHT * np.log1p(1000 * ratios[:, REPETITION])], axis=1)
    words = Words(column, lower=True, letters_only=True)
    row = np.repeat(np.arange(words.rows), words.counts())
    shift = np.uint64(64 - (WORDS.bit_length() - 1))
    cells, counts = np.unique(row * WORDS + (words.hashes() >> shift).astype(np.int64) if len(words) else np.zeros(0, np.int64), return_counts=True)
    at, place = np.nonzero(manner)
    rows = np.concatenate([at, cells // WORDS])
    columns = np.concatenate([place, MANNER + cells % WORDS])
    values = np.concatenate([manner[at, place], np.log1p(counts)])
    order = np.argsort(rows, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=words.rows))])
    return Terms(first, columns[order].astype(np.int64), values[order].astype(np.float32))


def packed_terms(terms: Terms) -> list[pa.Array]:
    """Columns and values of each row as binary values."""
    bounds = list(zip(terms.first[:-1], terms.first[1:]))
    return [pa.array([x[a:b].tobytes() for a, b in bounds], pa.binary()) for x in (terms.columns.astype(np.int32), terms.values.astype(np.float32))]


def unpacked_terms(columns: list[bytes], values: list[bytes]) -> Terms:
    sizes = np.array([len(x) // 4 for x in columns], dtype=np.int64)
    return Terms(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.frombuffer(b"".join(columns), dtype=np.int32).astype(np.int64),
                 np.frombuffer(b"".join(values), dtype=np.float32))


@dataclass
class Voters:
    """Term weights and singular vectors of the latent space, labelled vectors and their labels; ``prior`` answers where nothing compares."""

    weight: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, terms: Terms) -> np.ndarray:
        return unit_rows(terms.weighed(self.weight).times(self.space))

    def scores(self, terms: Terms, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, by similarity; equal similarities at the border go to the earlier labelled row."""
        out = np.full(len(terms), self.prior)
        if not len(self.vectors) or not len(terms):
            return out
        cosines = self.latent(terms) @ self.vectors.T
        k = min(neighbours, len(self.vectors))
        border = -np.partition(-cosines, k - 1, axis=1)[:, k - 1:k]
        above = cosines > border
        tied = cosines == border
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        near = np.nonzero(chosen)[1].reshape(len(cosines), k)
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        voted = total > 0
        out[voted] = (weight * self.labels[near]).sum(axis=1)[voted] / total[voted]
        return np.clip(out, 0, 1)


def latent_space(weighed: Terms, dimensions: int, rounds: int = 2, spare: int = 8) -> np.ndarray:
    """Leading right singular vectors (TERMS x at most ``dimensions``) by a randomised product with power rounds (Halko et al. 2011)."""
    width = min(dimensions + spare, len(weighed))
    turned = weighed.turned()
    seen = weighed.times(np.random.default_rng(5).standard_normal((TERMS, width), dtype=np.float32))
    for _ in range(rounds):
        seen = weighed.times(np.linalg.qr(turned.times(np.linalg.qr(seen)[0]))[0])
    left, _, _ = np.linalg.svd(turned.times(np.linalg.qr(seen)[0]), full_matrices=False)
    return np.ascontiguousarray(left[:, :dimensions], dtype=np.float32)


def fit_voters(terms: Terms, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Voters:
    """Latent space and vectors of labelled rows; without rows every score is one half."""
    if not len(terms):
        return Voters(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    weight = (np.log((1 + len(terms)) / (1 + terms.document_counts())) + 1).astype(np.float32)
    weighed = terms.weighed(weight)
    space = latent_space(weighed, dimensions)
    return Voters(weight, space, unit_rows(weighed.times(space)), labels.astype(np.float64), float(labels.mean()))


def fitted_voters(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABELLED, folds: int = 3, held_out: int = 1) -> Voters:
    """Voters from at most about ``bound`` labelled rows outside the held-out fold; their terms are all that reaches the driver."""
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed_terms(term_matrix(batch.column(1))), batch.column(2)],
                                             names=["doc_id", "columns", "values", "label"])

    sample = labelled_sample(docs, labels, label, bound, fold_of("doc_id", folds) != held_out, even=False)
    rows = sample.select("doc_id", "text", "label").mapInArrow(scan, "doc_id long, columns binary, values binary, label int")
    got = rows.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    terms = unpacked_terms(got.column("columns").to_pylist(), got.column("values").to_pylist())
    return fit_voters(terms, got.column("label").to_numpy().astype(int))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = LABELLED, folds: int = 3,
                   held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, scored on its whole text.

    Null and empty texts are scored like texts without terms (by their neighbours, else by the share of label 1). A row without an id is scored
    and counts as not held out. Repeated rows give repeated results; labels of rows not in ``docs``, null labels and other values than 0 and 1 are ignored.
    Very long texts count whole, as logarithms of frequencies. Of equally near labelled rows the one of the smaller id votes. Other columns are ignored
    whatever their names. An empty table gives no rows.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    voters = docs.sparkSession.sparkContext.broadcast(fitted_voters(named, labels, "quality", bound, folds, held_out))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(voters.value.scores(term_matrix(batch.column(1))))], names=["doc_id", "score"])

    scored = named.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
