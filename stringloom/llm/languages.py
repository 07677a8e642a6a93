"""Language of texts by the nearest of several centroids per language.

Texts are normalised TF-IDF vectors of byte trigrams of their letters. Each language has a few centroids found by spherical k-means, since texts of one language
differ. The nearest centroid by cosine gives the language; one farther away than almost all learnt texts of that language is also marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import LETTERS, fold_of, gram_counts, packed_rows, unit_rows, unpacked_rows
from .runtime import prepare
from .words import Words

BUCKETS = 4_096
CENTROIDS = 6
#: At most about so many texts of each language are learnt from, and so many languages are told apart.
TEXTS = 1_000
LANGUAGES = 200
#: Share of the learnt texts of a centroid's language that the rejection distance lets pass, and how sharply cosines turn into scores.
PASSING = 0.995
SHARPNESS = 30.0


def gram_matrix(column: pa.Array) -> np.ndarray:
    return gram_counts(Words(column), LETTERS, (3,), BUCKETS)


@dataclass
class Centroids:
    weight: np.ndarray
    centres: np.ndarray
    owner: np.ndarray  # language index of each centre
    names: list[str]
    reach: np.ndarray  # least cosine of each language

    def predict(self, grams: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, score and rejection of each row."""
        if not self.names:
            return [None] * len(grams), np.zeros(len(grams)), np.ones(len(grams), dtype=bool)
        cosines = unit_rows(np.sqrt(grams) * self.weight) @ self.centres.T
        best = np.full((len(grams), len(self.names)), -1.0)
        for k, language in enumerate(self.owner):
            best[:, language] = np.maximum(best[:, language], cosines[:, k])
        top = best.argmax(axis=1)
        raised = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
        score = raised.max(axis=1) / raised.sum(axis=1)
        return [self.names[t] for t in top], score, best.max(axis=1) < self.reach[top]


def clustered(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: centres of unit rows by cosine."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = unit_rows(sums)
    return centres


def fit_centroids(grams: np.ndarray, languages: list[str], k: int = CENTROIDS, seed: int = 3) -> Centroids:
    names = sorted(set(languages))
    known = np.array([names.index(x) for x in languages], dtype=int)
    weight = (np.log((1 + len(grams)) / (1 + (grams > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = unit_rows(np.sqrt(grams) * weight)
    rng = np.random.default_rng(seed)
    centres, owner, reach = [], [], []
    for language in range(len(names)):
        own = rows[known == language]
        found = clustered(own, k, rng)
        centres.append(found)
        owner += [language] * len(found)
        reach.append(np.quantile((own @ found.T).max(axis=1), 1 - PASSING))
    return Centroids(weight, np.concatenate(centres) if centres else np.zeros((0, BUCKETS), np.float32), np.array(owner, dtype=int), names, np.array(reach))


def fitted_centroids(docs: DataFrame, folds: int = 4, held_out: int = 2, bound: int = TEXTS) -> Centroids:
    """Centroids from about ``bound`` texts of each language outside the held-out fold; only their n-gram counts reach the driver."""
    prepare(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", folds) != held_out))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    wanted = F.lit(False)
    for r in counts:
        share = int(min(1.0, bound / r["n"]) * (1 << 30))
        wanted = wanted | ((F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed_rows(gram_matrix(batch.column(2)))], names=["doc_id", "lang", "grams"])

    # the expected number of rows is at most bound x languages; the limit only makes that a proof
    ids = known.where(wanted).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "lang").limit(2 * bound * max(len(counts), 1))
    rows = docs.join(F.broadcast(ids.withColumnRenamed("lang", "_lang").distinct()), "doc_id").where("lang = _lang")
    got = rows.select("doc_id", "lang", "text").mapInArrow(scan, "doc_id long, lang string, grams binary").dropDuplicates(["doc_id", "lang"]).toArrow()
    got = got.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    return fit_centroids(unpacked_rows(got.column("grams"), BUCKETS), got.column("lang").to_pylist())


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2,
              bound: int = TEXTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``, from its whole text.

    Texts that are null or have no letter are ``und`` with score 0 and rejected, as is everything where there is no language to learn. ``rejected`` marks texts
    that are farther from every centroid than almost all learnt ones. A row without an id is predicted and counts as not held out.
    Repeated rows give repeated results; other columns are ignored whatever their names. An empty table gives no rows.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fitted_centroids(named, folds, held_out, bound))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = model.value.predict(gram_matrix(batch.column(1)))
            spoken = np.array([any(map(str.isalpha, t or "")) for t in batch.column(1).to_pylist()], dtype=bool)
            names = [n if s and n is not None else "und" for n, s in zip(names, spoken)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(spoken, score, 0.0)), pa.array(rejected | ~spoken)],
                                             names=["doc_id", "lang_pred", "score", "rejected"])

    found = named.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
