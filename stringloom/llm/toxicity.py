"""Toxic spans and documents by a linear-chain conditional random field.

Labels mark documents, so tokens are labelled first: words and word beginnings that stand (almost) only in toxic documents, and in more of them than chance
explains, are markers. Tokens with a marker in toxic documents are toxic, all others are not. The field has two states,
features of the word and of its beginnings, and transitions; it is fitted by gradient steps on the exact likelihood. Every text then gets the forward-backward
marginals of all its tokens; their largest value and the sum of their squares give the document's score, tokens over one half the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import normal_words
from .grams import fold_of
from .rules import labelled_sample
from .runtime import prepare, written
from .words import Words, _span_hashes, mixed, window_hashes

#: Bytes of the word beginnings that are features, and the size of the weight table.
PREFIXES = (3, 4, 5, 6)
BUCKETS = 1 << 17
#: At most about so many labelled documents, half of them toxic, are fitted on. They are taken whole, in the order of a hash of their ids and whatever their
#: lengths, as long as those before them hold less than so many characters together: what reaches the driver is bounded.
DOCUMENTS = 2_400
CHARACTERS = 24_000_000
#: Words of a passage. The fit cuts documents into passages, all of which it uses; scores come from unbroken chains.
PASSAGE = 512
#: A marker's share of toxic documents among those that have it, and the share of toxic documents it must stand in at least.
PRECISION = 0.97
SUPPORT = 0.01
STEPS = 40


def token_features(words: Words) -> np.ndarray:
    """Feature hashes of each word: itself and its beginnings; a word shorter than a beginning repeats itself."""
    columns = [words.hashes()]
    for k in PREFIXES:
        ends = np.minimum(words.ends, words.starts + k)
        columns.append(mixed(_span_hashes(words.data, words.starts, ends) + np.uint64(k)) if len(words) else columns[0])
        columns[-1] = np.where(words.ends - words.starts > k, columns[-1], columns[0])
    return np.stack(columns, axis=1)


def buckets_of(features: np.ndarray) -> np.ndarray:
    return (features & np.uint64(BUCKETS - 1)).astype(np.int64)


def dissimilar(words: Words, hashes: np.ndarray, width: int = 5, smallest: int = 4) -> np.ndarray:
    """Rows that share none of their smallest window hashes with an earlier row, so that copies count once as evidence."""
    seen: set[int] = set()
    keep = np.zeros(words.rows, dtype=bool)
    for r in range(words.rows):
        own = np.sort(window_hashes(hashes[words.first[r]:words.first[r + 1]], width))[:smallest].tolist()
        keep[r] = seen.isdisjoint(own)
        seen.update(own)
    return keep


def markers(features: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Hashes of the features of toxic documents: precise, and in so many that not one feature is expected there by chance."""
    row = np.repeat(np.repeat(np.arange(len(first) - 1), np.diff(first)), features.shape[1])
    name = features.ravel()
    order = np.lexsort((row, name))
    name, row = name[order], row[order]
    once = np.ones(len(name), dtype=bool)
    once[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    names, begin, count = np.unique(name[once], return_index=True, return_counts=True)
    bad = np.add.reduceat(toxic[row[once]].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    chance = np.log(max(len(names), 2)) / -np.log(np.clip(toxic.mean(), 0.01, 0.9))
    return names[(bad >= max(chance, SUPPORT * toxic.sum())) & (bad >= PRECISION * count)]


def _walk(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows from the longest to the shortest, and how many of them have a word at each place."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(1, int(sizes.max(initial=0)) + 1))
    return order, active


def chain(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of the toxic state of each token, forward odds, backward odds) of each row's chain.

    ``emission`` is the log odds that a token's features give, ``moves`` the 2 x 2 transition factors. Odds of toxic to clean say all about two states.
    """
    factor = np.exp(np.clip(emission, -30, 30))
    forward, backward = np.empty(len(emission)), np.ones(len(emission))
    order, active = _walk(first)
    begin, end = first[:-1][order], first[1:][order]
    odds = None
    for t, n in enumerate(active):
        at = begin[:n] + t
        came = 1.0 if odds is None else (moves[0, 1] + moves[1, 1] * odds[:n]) / (moves[0, 0] + moves[1, 0] * odds[:n])
        odds = factor[at] * came
        forward[at] = odds
    odds = None
    for t, n in enumerate(active):
        at = end[:n] - 1 - t
        if odds is not None:
            later = odds[:n] * factor[at + 1]
            backward[at] = (moves[1, 0] + moves[1, 1] * later) / (moves[0, 0] + moves[0, 1] * later)
        odds = backward[at]
    both = forward * backward
    return both / (1 + both), forward, backward


@dataclass
class Field:
    """Weights of feature buckets, bias, transition factors and the calibration of document scores."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    calibration: np.ndarray

    def emission(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights[buckets].sum(axis=1) + self.bias

    def evidence(self, marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Constant, log odds of the largest marginal, and log of the sum of squared marginals of each row."""
        out = np.zeros((len(first) - 1, 3))
        out[:, 0] = 1
        full = np.flatnonzero(np.diff(first) > 0)
        out[:, 1] = -8
        if len(full):
            top = np.clip(np.maximum.reduceat(marginals, first[full]), np.exp(-8), 1 - np.exp(-8))
            out[full, 1] = np.log(top / (1 - top))
            out[full, 2] = np.log1p(np.add.reduceat(marginals**2, first[full]))
        return out

    def scores(self, marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(marginals, first) @ self.calibration, -30, 30)))


def calibrated(evidence: np.ndarray, toxic: np.ndarray, rounds: int = 25, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression of the label on the evidence."""
    b = np.zeros(evidence.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(evidence @ b, -30, 30)))
        slope = evidence.T @ (toxic - p) - ridge * b
        curve = (evidence * (p * (1 - p))[:, None]).T @ evidence + ridge * np.eye(len(b))
        b = b + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return b


def passages(first: np.ndarray, width: int = PASSAGE) -> np.ndarray:
    """Borders of the passages of at most ``width`` words that rows with the borders ``first`` are cut into."""
    cuts = [np.arange(a, b, width) for a, b in zip(first[:-1], first[1:])]
    return np.concatenate([*cuts, first[-1:]])


def fit_field(texts: list[str], toxic: np.ndarray, steps: int = STEPS) -> Field:
    """Field fitted on labelled texts. Where all labels are equal they are the scores; without labels or words nothing is toxic."""
    words = normal_words(pa.array(texts, pa.string()))
    if not len(words) or len(np.unique(toxic)) < 2:
        sure = 30.0 if len(toxic) and toxic.all() else -30.0
        return Field(np.zeros(BUCKETS), 0.0, np.ones((2, 2)), np.array([sure, 0.0, 0.0]))
    keep = dissimilar(words, words.hashes())
    texts, toxic = [t for t, k in zip(texts, keep) if k], toxic[keep]
    words = normal_words(pa.array(texts, pa.string()))
    features = token_features(words)
    row = np.repeat(np.arange(words.rows), words.counts())
    labels = np.isin(features, markers(features, words.first, toxic)).any(axis=1) & (toxic[row] == 1)
    buckets = buckets_of(features)
    first = passages(words.first)
    y = labels.astype(np.float64)
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1]] = False  # tokens with one before them in their passage
    later = np.flatnonzero(inner)
    from_, to = y[later - 1], y[later]
    seen = np.array([[((1 - from_) * (1 - to)).sum(), ((1 - from_) * to).sum()], [(from_ * (1 - to)).sum(), (from_ * to).sum()]])
    weights, bias, log_moves = np.zeros(BUCKETS), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros((2, 2))
    flat = buckets.ravel()
    # coordinates move by their own scale: rare features as far as frequent ones
    memory = [np.full(BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(steps):
        moves = np.exp(log_moves)
        emission = weights[buckets].sum(axis=1) + bias
        marginal, forward, backward = chain(emission, first, moves)
        slope = np.bincount(flat, weights=np.repeat(y - marginal, buckets.shape[1]), minlength=BUCKETS) - 0.01 * weights
        # expected transitions: odds of the four state pairs around each border
        factor = np.exp(np.clip(emission[later], -30, 30)) * backward[later]
        joint = np.stack([np.full(len(later), moves[0, 0]), moves[0, 1] * factor, moves[1, 0] * forward[later - 1], moves[1, 1] * forward[later - 1] * factor])
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        slopes = [slope, float((y - marginal).sum()), seen - expected - 0.01 * log_moves]
        moved = []
        for k, s in enumerate(slopes):
            memory[k] = memory[k] + s * s
            moved.append(0.7 * s / np.sqrt(memory[k]))
        weights, bias, log_moves = weights + moved[0], bias + moved[1], log_moves + moved[2]
    field = Field(weights.astype(np.float32), float(bias), np.exp(log_moves), np.zeros(3))
    marginal, _, _ = chain(field.emission(buckets), words.first, field.moves)
    field.calibration = calibrated(field.evidence(marginal, words.first), toxic.astype(np.float64))
    return field


def fitted_field(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = DOCUMENTS, characters: int = CHARACTERS, folds: int = 5,
                 held_out: int = 0) -> Field:
    """Field from at most about ``bound`` labelled documents outside the held-out fold, whole texts of about ``characters`` together; only these reach the driver."""
    sample = labelled_sample(docs, labels, label, bound, fold_of("doc_id", folds) != held_out).dropDuplicates(["doc_id"])
    sample = written(sample.select("doc_id", "text", "label", F.length("text").alias("size")), "labelled")
    before = F.coalesce(F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most 2 * bound rows of an id and a length meet in this window
    taken = sample.select("doc_id", "size").withColumn("before", before).where(F.col("before") < characters).select("doc_id")
    rows = sample.join(F.broadcast(taken), "doc_id", "left_semi").orderBy("doc_id").collect()
    return fit_field([r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=int))


def toxic_spans(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = DOCUMENTS, folds: int = 5,
                held_out: int = 0) -> DataFrame:
    """(doc_id, score, spans) for every row of ``docs``, from its whole text; spans are (start, end, marginal) of tokens that are toxic rather than not.

    Starts and ends are code points of the lower-cased text. Null and empty texts have no spans and the score of a text without evidence. Very long texts are
    fitted and tagged whole; a document that must be chosen among equals is chosen by a hash of its id. Repeated rows give
    repeated results; null labels and other values than 0 and 1 are ignored. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(fitted_field(named, labels, label, bound, folds=folds, held_out=held_out))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = field.value
        for batch in batches:
            words = normal_words(batch.column(1))
            marginals, _, _ = chain(known.emission(buckets_of(token_features(words))) if len(words) else np.zeros(0), words.first, known.moves)
            hits = np.flatnonzero(marginals > 0.5)
            row = np.searchsorted(words.first, hits, side="right") - 1
            starts, ends = words.character(words.starts[hits], row), words.character(words.ends[hits], row)
            spans: list[list[dict]] = [[] for _ in range(words.rows)]
            for r, a, b, m in zip(row.tolist(), starts, ends, marginals[hits].tolist()):
                spans[r].append({"start": a, "end": b, "marginal": m})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(known.scores(marginals, words.first)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])))], names=["doc_id", "score", "spans"])

    return named.mapInArrow(tag, "doc_id long, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of ``docs``; a row without an id counts as not held out."""
    got = toxic_spans(docs, labels, folds=folds, held_out=held_out)
    return got.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
