from pyspark.sql import functions as F

from stringloom import batch
from stringloom.learn import candidates, naive_bayes
from stringloom.operators import report
from stringloom.plans.scratch import scratch_path

ROWS = [(i, t, l) for i, (t, l) in enumerate([("red ring gold", "ring"), ("blue bolt steel", "bolt"), ("tin cup small", "cup")] * 20)]


def rows_of(spark):
    return spark.createDataFrame(ROWS + [(999, "no label", None)], "id long, string string, label string")


def test_candidates_ensemble_and_reload(spark):
    rows = rows_of(spark)
    trained = candidates.train_candidates(rows, "label", ["string"], exclude=["RandomForest"], folds=2)
    assert set(trained.models) == {"LogisticRegression", "NaiveBayes", "DecisionTree"}
    board = trained.leaderboard(spark).collect()
    assert {r["model"] for r in board} == set(trained.models) | {candidates.ENSEMBLE}
    assert [r["score"] for r in board] == sorted((r["score"] for r in board), reverse=True)
    scored = report.report_columns(trained.score(rows.where("label is not null")), "label")
    assert report.accuracy(scored, "Predicted_label", "label").first()["accuracy"] == 1.0
    total = scored.select(F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["prob"]).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in total)
    path = scratch_path(spark, "saved")
    trained.save(path)
    again = candidates.load_models(spark, path)
    for name in (None, "NaiveBayes"):
        a = {r["id"]: r["classes"] for r in trained.score(rows, name).collect()}
        b = {r["id"]: r["classes"] for r in again.score(rows, name).collect()}
        assert a == b


def test_greedy_weights(spark):
    held = spark.createDataFrame([(0.0, [0.9, 0.1], [0.4, 0.6]), (1.0, [0.6, 0.4], [0.1, 0.9]), (0.0, [0.8, 0.2], [0.3, 0.7])],
                                 "target double, p_x array<double>, p_y array<double>")
    weights, score = candidates.ensemble_weights(held, ["x", "y"])
    # x alone is right twice, y once, their average on all three
    assert score == 1.0 and weights == {"x": 0.5, "y": 0.5} and abs(sum(weights.values()) - 1) < 1e-12


def test_word_model_reload_and_unseen_words(spark):
    rows = rows_of(spark)
    model = naive_bayes.fit_word_model(rows, "label")
    path = scratch_path(spark, "words")
    model.save(path)
    again = naive_bayes.load_word_model(spark, path)
    new = spark.createDataFrame([(1, "unseen words only"), (2, "gold ring")], "id long, string string")
    got = {r["id"]: {c["label"]: c["prob"] for c in r["classes"]} for r in naive_bayes.score_words(again, new).collect()}
    assert all(abs(p - 1 / 3) < 1e-9 for p in got[1].values())
    assert max(got[2], key=got[2].get) == "ring"


def test_batch_stops_at_the_failing_stage(spark):
    import pytest
    records = spark.createDataFrame([("s", "red ring", "o1", "1", 2024, 1)], "DataSourceName string, `Dimension Value` string, Owner string, NCM string, Year int, Month int")
    listed = spark.createDataFrame([("x", "o9")], "Code string, Company string")
    started = []

    def broken(rows):
        started.append("first")
        raise RuntimeError("no model")

    def second(rows):
        started.append("second")

    with pytest.raises(batch.StageFailed, match="score Ingredient"):
        batch.run_batch(records, listed, {"Ingredient": broken, "Trademark": second}, "s", scratch_path(spark, "batch"))
    assert started == ["first"]


def test_twenty_thousand_classes_are_fitted_saved_loaded_and_scored(spark, monkeypatch):
    many = spark.range(20_000).selectExpr("id", "concat('own', id, ' shared', id % 7) as string", "concat('class', id) as label")
    path = scratch_path(spark, "many")
    naive_bayes.fit_word_model(many, "label").save(path)
    model = naive_bayes.load_word_model(spark, path)
    asked = spark.createDataFrame([(1, "own77 shared0"), (2, "own19999"), (3, "nothing known"), (None, "own5")], "id long, string string")
    got = {r["id"]: r["classes"] for r in naive_bayes.score_words(model, asked, top=3).collect()}
    assert got[1][0]["label"] == "class77" and got[2][0]["label"] == "class19999"
    assert all(len(c) == 3 for c in got.values()) and got[1][0]["prob"] > got[1][1]["prob"] >= got[1][2]["prob"] > 0
    assert all(abs(got[k][0]["prob"] - 1 / 20_000) < 1e-9 for k in (3, None))  # no known word, and a row without a key


def test_class_blocks_change_nothing(spark, monkeypatch):
    model = naive_bayes.fit_word_model(rows_of(spark), "label")
    asked = spark.createDataFrame([(1, "red ring of tin"), (2, "steel"), (3, "")], "id long, string string")
    whole = sorted(naive_bayes.score_words(model, asked).collect())
    monkeypatch.setattr(naive_bayes, "BLOCK", 2)
    cut = sorted(naive_bayes.score_words(model, asked).collect())
    assert [[c["label"] for c in r["classes"]] for r in cut] == [["bolt", "cup", "ring"]] * 3
    assert all(abs(a["prob"] - b["prob"]) < 1e-12 for x, y in zip(whole, cut) for a, b in zip(x["classes"], y["classes"]))
    best = naive_bayes.score_words(model, asked, top=1).collect()
    assert {r["id"]: r["classes"][0]["label"] for r in best}[2] == "bolt"


def test_word_models_of_two_columns_are_mixed_class_by_class(spark):
    rows = spark.createDataFrame([(1, "red ring", "aa", "x"), (2, "blue bolt", "bb", "y"), (3, "tin cup", "aa", "x"), (4, None, "bb", None), (5, "red", None, "z")],
                                 "id long, string string, brand string, label string")
    one = naive_bayes.score_words(naive_bayes.fit_word_model(rows, "label"), rows).withColumnRenamed("classes", "first")
    both = naive_bayes.score_words(naive_bayes.fit_word_model(rows, "label", "brand"), one, text="brand")
    got = both.withColumn("mixed", candidates.mixed_classes([F.col("first"), F.col("classes")], [3.0, 1.0])).collect()
    assert len(got) == 5
    for r in got:
        assert [c["label"] for c in r["mixed"]] == ["x", "y", "z"] and abs(sum(c["prob"] for c in r["mixed"]) - 1) < 1e-9
        assert all(abs(m["prob"] - 0.75 * a["prob"] - 0.25 * b["prob"]) < 1e-12 for m, a, b in zip(r["mixed"], r["first"], r["classes"]))


def test_common_words_are_weighed_where_a_row_is_read(spark, monkeypatch):
    data = [(1, "p", "red red ring"), (2, "q", "blue ring bolt"), (3, "p", "red oak"), (None, "q", "blue ring"), (1, "q", "oak oak bolt"), (4, None, "ring ring new"), (5, "p", None)]
    rows = spark.createDataFrame(data, "id long, label string, string string")
    model = naive_bayes.fit_word_model(rows, "label")
    found, joined = [], naive_bayes.lookup_join

    def scored():
        got = naive_bayes.score_words(model, rows).collect()
        return sorted((r["id"] or 0, r["label"] or "", [round(c["prob"], 9) for c in r["classes"]]) for r in got)

    monkeypatch.setattr(naive_bayes, "lookup_join", lambda many, one, key, total, *a: found.append(total) or joined(many, one, key, total, *a))
    all_common = scored()
    monkeypatch.setattr(naive_bayes, "COMMON", 3)
    some = scored()
    monkeypatch.setattr(naive_bayes, "ENTRIES", 0)
    none = scored()
    assert all_common == some == none
    assert found[0] == 1 and found[0] < found[1] < found[2]


def test_texts_are_split_once_for_all_features(spark, monkeypatch):
    fitted_on = []

    class Recorded(candidates.IDF):
        def fit(self, data):
            fitted_on.append(data.columns)
            return super().fit(data)

    monkeypatch.setattr(candidates, "IDF", Recorded)
    data = spark.createDataFrame([(1, "red ring red"), (2, ""), (3, "blue bolt"), (None, "ring")], "key long, text string")
    features, got = candidates._fitted_features(data)
    assert fitted_on == [["key", "wide_counts", "narrow_counts"]] * 2  # neither texts nor words are read again
    want = {r["key"]: (r["wide"], r["narrow"]) for r in features.transform(data).collect()}
    assert {r["key"]: (r["wide"], r["narrow"]) for r in got.collect()} == want and len(want) == 4
