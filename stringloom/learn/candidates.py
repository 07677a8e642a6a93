"""Several text classifiers fitted side by side, scored out of fold and combined."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD
from ..plans.scratch import written

# Training limits in seconds and the ensemble's name.
TIME_LIMIT = 14_400
INFER_LIMIT = 0.05
ENSEMBLE = "WeightedEnsemble_L2Best"
#: Megabytes of rows whose gradient is added up at once; for each block a task fills a matrix of all classes and columns, so small blocks cost more than their rows.
STACKED = 16.0


def _learners(seed: int) -> dict:
    """Candidates by name; trees read the narrow feature columns."""
    return {
        "LogisticRegression": LogisticRegression(featuresCol="wide", maxIter=50, regParam=1e-4, maxBlockSizeInMB=STACKED),
        "NaiveBayes": NaiveBayes(featuresCol="wide"),
        "DecisionTree": DecisionTreeClassifier(featuresCol="narrow", maxDepth=8, seed=seed),
        "RandomForest": RandomForestClassifier(featuresCol="narrow", numTrees=20, maxDepth=8, seed=seed),
    }


def _fitted_features(data: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Hashed word counts weighed by idf, in a wide and a narrow form; both widths are fixed. And ``data`` with them, its texts split only once."""
    tokens = RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD, gaps=False, toLowercase=True)
    hashed = {name: HashingTF(inputCol="words", outputCol=f"{name}_counts", numFeatures=width) for name, width in (("wide", 1 << 16), ("narrow", 1 << 10))}
    counted = written(PipelineModel([tokens, *hashed.values()]).transform(data).drop("text", "words"), "word_counts")
    weighed = {name: IDF(inputCol=f"{name}_counts", outputCol=name).fit(counted) for name in hashed}
    stages = [tokens] + [stage for name in hashed for stage in (hashed[name], weighed[name])]
    return PipelineModel(stages), PipelineModel(list(weighed.values())).transform(counted)


def joined_text(columns: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])


def class_array(probs: Column, labels: Sequence[str]) -> Column:
    """array<struct<label, prob>> from a plain array of probabilities."""
    names = F.from_json(F.lit(json.dumps(list(labels))), "array<string>")
    return F.zip_with(names, probs, lambda name, p: F.struct(name.alias("label"), p.alias("prob")))


def weighted_average(arrays: Sequence[Column], weights: Sequence[float]) -> Column:
    """Element-wise average of probability arrays."""
    def scaled_by(array: Column, share: float) -> Column:
        return F.transform(array, lambda p: p * F.lit(share))

    scaled = [scaled_by(a, w / sum(weights)) for a, w in zip(arrays, weights)]
    return reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p + q), scaled)


def mixed_classes(arrays: Sequence[Column], weights: Sequence[float]) -> Column:
    """One array<struct<label, prob>> from several that list the same labels in the same order."""
    mean = weighted_average([F.transform(a, lambda e: e["prob"]) for a in arrays], weights)
    return F.zip_with(arrays[0], mean, lambda e, p: F.struct(e["label"].alias("label"), p.alias("prob")))


@dataclass
class TrainedModels:
    labels: list[str]
    text_columns: list[str]
    features: PipelineModel
    models: dict[str, PipelineModel]
    weights: dict[str, float]
    board: list[dict] = field(default_factory=list)

    @property
    def best(self) -> str:
        return ENSEMBLE if self.weights else max(self.board, key=lambda r: r["score"])["model"]

    def leaderboard(self, spark: SparkSession) -> DataFrame:
        """One row per candidate and the ensemble: accuracy out of fold, seconds to fit and to predict."""
        rows = spark.createDataFrame(self.board, "model string, score double, fit_time double, pred_time double")
        return rows.orderBy(F.desc("score"), "model")

    def score(self, rows: DataFrame, model_name: str | None = None) -> DataFrame:
        """``rows`` with ``classes`` of the named model (the best by default), in one pass over the rows."""
        name = model_name or self.best
        parts = self.weights if name == ENSEMBLE else {name: 1.0}
        named = [F.col(f"`{c}`") for c in rows.columns]
        out = self.features.transform(rows.withColumn("text", joined_text(self.text_columns))).select(*named, "wide", "narrow")
        for part in parts:
            scored = self.models[part].transform(out)
            out = scored.select(*[F.col(f"`{c}`") for c in out.columns], vector_to_array("probability").alias(f"p_{part}"))
        mixed = weighted_average([F.col(f"p_{p}") for p in parts], list(parts.values()))
        return out.select(*named, class_array(mixed, self.labels).alias("classes"))

    def save(self, path: str) -> None:
        self.features.write().save(f"{path}/features")
        for name, model in self.models.items():
            model.write().save(f"{path}/models/{name}")
        spark = SparkSession.getActiveSession()
        meta = json.dumps({"labels": self.labels, "text_columns": self.text_columns, "weights": self.weights,
                           "board": self.board, "models": list(self.models)})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def load_models(spark: SparkSession, path: str) -> TrainedModels:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    models = {name: PipelineModel.load(f"{path}/models/{name}") for name in meta["models"]}
    return TrainedModels(meta["labels"], meta["text_columns"], PipelineModel.load(f"{path}/features"), models, meta["weights"], meta["board"])


def ensemble_weights(out_of_fold: DataFrame, names: Sequence[str], steps: int = 10) -> tuple[dict[str, float], float]:
    """Greedy selection with replacement (Caruana et al. 2004) on (target, p_<name>...); (weights, accuracy).

    Each step tries every candidate in a single aggregate over the table.
    """
    picked: list[str] = []
    best = 0.0
    for _ in range(steps):
        tries = {}
        for name in names:
            mean = weighted_average([F.col(f"p_{n}") for n in picked + [name]], [1.0] * (len(picked) + 1))
            hit = (F.array_position(mean, F.array_max(mean)) - 1) == F.col("target")
            tries[name] = F.avg(hit.cast("double")).alias(name)
        row = out_of_fold.agg(*tries.values()).first().asDict()
        name = max(sorted(row), key=lambda n: row[n])
        if picked and row[name] <= best:
            break
        picked.append(name)
        best = row[name]
    return {n: picked.count(n) / len(picked) for n in dict.fromkeys(picked)}, best


def train_candidates(rows: DataFrame, label: str, text_columns: Sequence[str], key: str = "id", exclude: Iterable[str] = (),
                     folds: int = 3, time_limit: float = TIME_LIMIT, infer_limit: float = INFER_LIMIT, seed: int = 42) -> TrainedModels:
    """Fit every candidate not excluded; keep those within the prediction limit per row; weigh them into an ensemble.

    Rows without a label are dropped. Candidates not started within ``time_limit`` seconds are skipped.
    """
    started = time.monotonic()
    data = rows.where(F.col(label).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).cast("string").alias("label"), joined_text(text_columns).alias("text"),
        F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).alias("fold"))
    indexer: StringIndexerModel = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc").fit(data)
    features, data = _fitted_features(indexer.transform(data).drop("label"))
    data = written(data.select("key", "target", "fold", "wide", "narrow"), "training")
    total = data.count()
    models, board, held = {}, [], None
    for name, learner in _learners(seed).items():
        if name in set(exclude) or (models and time.monotonic() - started > time_limit):
            continue
        pipe, fit_time, parts = Pipeline(stages=[learner.setLabelCol("target")]), 0.0, []
        for fold in range(folds):
            begun = time.monotonic()
            model = pipe.fit(data.where(F.col("fold") != fold))
            fit_time += time.monotonic() - begun
            parts.append(model.transform(data.where(F.col("fold") == fold)).select("key", "target", vector_to_array("probability").alias(f"p_{name}")))
        begun = time.monotonic()
        scored = written(reduce(lambda a, b: a.unionByName(b), parts), "out_of_fold")
        pred_time = time.monotonic() - begun
        if pred_time / max(total, 1) > infer_limit:
            continue
        guess = F.array_position(F.col(f"p_{name}"), F.array_max(f"p_{name}")) - 1
        accuracy = scored.agg(F.avg((guess == F.col("target")).cast("double"))).first()[0]
        begun = time.monotonic()
        models[name] = pipe.fit(data)
        board.append({"model": name, "score": accuracy, "fit_time": fit_time + time.monotonic() - begun, "pred_time": pred_time})
        held = scored if held is None else held.join(scored.drop("target"), "key")
    if not models:
        raise ValueError("no candidate within the limits")
    weights, mixed = ensemble_weights(written(held, "held_out"), list(models))
    board.append({"model": ENSEMBLE, "score": mixed, "fit_time": sum(b["fit_time"] for b in board if b["model"] in weights),
                  "pred_time": sum(b["pred_time"] for b in board if b["model"] in weights)})
    return TrainedModels(indexer.labels, list(text_columns), features, models, weights, board)
