import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.operators import neighbours, vectors
from stringloom.operators.clusters.dbscan import dbscan
from stringloom.operators.clusters.optics import optics_at
from stringloom.operators.components import components
from stringloom.operators.vectors import NoWords, rejected_strings, row_weights, term_vectors
from stringloom.plans import trees
from stringloom.plans.ranking import with_position
from stringloom.plans.scratch import written
from stringloom.plans.skew import salted_join
from tests import brute


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, string string")


def test_weights_are_unit_rows_for_copies_too(text_frame, texts):
    norms = row_weights(term_vectors(text_frame)).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == len(texts) and all(abs(r["n"] - 1) < 1e-9 for r in norms)


@pytest.mark.parametrize("eps", [0.2, 0.9, 1.2, 1.4])
@pytest.mark.parametrize("block", [2_000, 5])
def test_pairs_equal_brute_force(text_frame, texts, eps, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    tv = term_vectors(text_frame)
    got = {(r["a"], r["b"]): r["dist"] for r in neighbours.close_pairs(tv.vectors, eps).collect()}
    d = brute.distances(brute.tfidf(texts))
    first = sorted(r["vec"] for r in tv.vectors.select("vec").collect())
    want = {(a, b): d[a, b] for a in first for b in first if a < b and d[a, b] <= eps}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_radius_of_everything_is_refused(text_frame):
    with pytest.raises(ValueError):
        neighbours.close_pairs(term_vectors(text_frame).vectors, math.sqrt(2))


def test_wordless_and_null_strings(spark):
    rows = frame(spark, ["red ring", "red ring", "a", "!", "", "blue bolt", None])
    assert [r["id"] for r in rejected_strings(rows).collect()] == [6]
    near = {r["id"]: r["label"] for r in dbscan(rows, 0.2, 2).collect()}
    assert near == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: -1}
    wide = {r["id"]: r["label"] for r in dbscan(rows, 1.0, 2).collect()}
    assert set(wide.values()) == {0}
    with pytest.raises(NoWords):
        term_vectors(frame(spark, ["a", "!"]))


def test_all_equal_and_single_rows(spark):
    same = dbscan(frame(spark, ["tin cup"] * 5), 0.2, 3).collect()
    assert {(r["label"], r["cluster"], r["is_noise"]) for r in same} == {(0, 1, False)}
    one = dbscan(frame(spark, ["tin cup"]), 0.2, 3).collect()
    assert [(r["label"], r["is_noise"]) for r in one] == [(-1, True)]


def test_early_border_rows_are_noise_in_the_ordering_cut(spark):
    texts = ["oak desk lamp red", "oak desk lamp", "oak desk lamp", "oak desk lamp", "oak desk lamp blue"]
    d = brute.distances(brute.tfidf(texts))
    eps = float(max(d[0, 1], d[4, 1])) + 0.01
    assert d[0, 4] > eps
    got = {r["id"]: r["label"] for r in optics_at(frame(spark, texts), 5, eps).collect()}
    assert got[1] == got[2] == got[3] == 0
    assert (got[0], got[4]) == (-1, 0)


def test_copies_of_a_border_row_have_their_own_turn(spark):
    rows = [(0, "dd bx"), (20, "dd bx"), (5, "aa bb cc dd"), (6, "aa n1a"), (7, "bb n2a"), (8, "cc n3a")]
    got = {r["id"]: r["label"] for r in optics_at(spark.createDataFrame(rows, "id long, string string"), 5, 1.3).collect()}
    assert got[0] == -1 and got[20] == 0 and got[5] == 0


def test_join_keeps_pairs_near_the_outer_radius(spark):
    from stringloom.operators.neighbours import close_pairs
    unit = lambda x: [x, (1 - x * x) ** 0.5]
    rows = [(0, 1, [4, 5], unit(2e-5)[::-1]), (1, 1, [5, 6], unit(1e-4)[::-1]), (2, 1, [7, 8], [0.6, 0.8])]
    found = close_pairs(spark.createDataFrame(rows, "vec long, copies long, terms array<bigint>, weights array<double>"), 1.414213)
    assert [(r["a"], r["b"]) for r in found.collect()] == [(0, 1)]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_same_clusters_for_any_partitioning(spark, texts, parts):
    rows = frame(spark, texts).orderBy(F.rand(parts)).repartition(parts)
    got = [r["label"] for r in dbscan(rows, 0.9, 4).orderBy("id").collect()]
    assert got == brute.dbscan(brute.distances(brute.tfidf(texts)), 0.9, 4)


def test_components_of_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + k] == 100 for k in range(20)) and got[201] == 200


def test_tree_computations(spark):
    # 0 <- 1 <- 2 <- 3 (a chain), 1 <- 4, and a second root 5
    nodes = spark.createDataFrame([(0, None, 1.0, False), (1, 0, 2.0, True), (2, 1, 9.0, True), (3, 2, 4.0, False), (4, 1, 3.0, False), (5, None, 6.0, True)],
                                  "id long, parent long, own double, marked boolean")
    sums = {r["id"]: r["sum"] for r in trees.subtree_sums(nodes.withColumn("value", F.col("own")), 6).collect()}
    assert sums == {0: 19.0, 1: 18.0, 2: 13.0, 3: 4.0, 4: 3.0, 5: 6.0}
    near = {r["id"]: r["mark"] for r in trees.nearest_marked(nodes, 6).collect()}
    assert near == {0: None, 1: 1, 2: 2, 3: 2, 4: 1, 5: 5}
    top = {r["id"]: r["mark"] for r in trees.topmost_marked(nodes, 6).collect()}
    assert top == {0: None, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    best = {r["id"]: (r["best"], r["below"]) for r in trees.best_of_subtrees(nodes, 6).collect()}
    assert best == {3: (4.0, 0.0), 2: (9.0, 4.0), 4: (3.0, 0.0), 1: (12.0, 12.0), 0: (12.0, 12.0), 5: (6.0, 0.0)}


def test_a_key_with_half_of_all_rows_is_dealt_over_many_tasks(spark, monkeypatch):
    from stringloom.plans import skew
    monkeypatch.setattr(skew, "LIMIT", 1_000)
    rows = spark.range(1_000_000).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 5_000).alias("k"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = salted_join(rows, sizes, "k", "n", 1_000_000, "id").withColumn("task", F.spark_partition_id())
    by_task = [r["count"] for r in out.groupBy("task").count().collect()]
    assert sum(by_task) == 1_000_000 and max(by_task) < 2 * 1_000_000 / len(by_task) and len(by_task) >= 4
    assert out.where("k = -1").agg(F.min("n"), F.max("n"), F.countDistinct("id")).first()[:] == (500_000, 500_000, 500_000)


def test_positions_and_hot_keys(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x")).repartition(5)
    assert all(r["x"] == r["position"] for r in with_position(df, ["x"]).collect())
    from stringloom.plans import skew
    rows = spark.range(400_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = salted_join(rows, sizes, "k", "n", 400_000, "id")
    assert out.count() == 400_000 and out.select("id").distinct().count() == 400_000
    assert out.where("k = 0").select("n").distinct().count() == 1


def test_terms_beyond_the_broadcast_ones_change_nothing(spark, texts, monkeypatch):
    rows = frame(spark, texts + ["", "solo word word", "solo word word"])
    whole = term_vectors(rows)
    want = {r["vec"]: (r["copies"], r["terms"], [round(w, 12) for w in r["weights"]]) for r in whole.vectors.collect()}
    weights = {(r["id"], r["term"]): round(r["weight"], 12) for r in row_weights(whole).collect()}
    monkeypatch.setattr(vectors, "COMMON", 5)
    cut = term_vectors(rows)
    assert cut.vocabulary > 5 and cut.entries == whole.entries and cut.row_entries == whole.row_entries
    assert {r["vec"]: (r["copies"], r["terms"], [round(w, 12) for w in r["weights"]]) for r in cut.vectors.collect()} == want
    assert {(r["id"], r["term"]): round(r["weight"], 12) for r in row_weights(cut).collect()} == weights
    assert want[90] == (1, [], []) and want[91][0] == 2


def test_no_pair_of_vector_and_common_term_is_shuffled(spark, tmp_path):
    rows = spark.range(2_000).selectExpr("id", "concat('all words of row', id % 1000, ' are here') as string")
    tv = term_vectors(rows)
    packed = vectors._packed(tv.members.where("id = vec").select("vec", "copies", F.array(F.lit("all")).alias("terms"), F.array(F.lit(1)).alias("counts")),
                             tv.terms, tv.vocabulary, tv.entries)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and tv.vectors.count() == 1_000


def test_words_are_not_shuffled_to_collapse_copies(spark, monkeypatch, tmp_path):
    kept = {}
    monkeypatch.setattr(vectors, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    rows = spark.createDataFrame([(3, "red ring"), (1, "ring red"), (2, "bolt"), (None, "bolt"), (None, "nut"), (4, ""), (1, "ring red")], "id long, string string")
    tv = term_vectors(rows)
    assert "terms" not in kept["groups"].columns  # a group is its key, a row and a count
    assert {(r["vec"], r["copies"], len(r["terms"])) for r in tv.vectors.collect()} == {(1, 3, 2), (2, 2, 1), (4, 1, 0)}
    assert {r["term"]: r["df"] for r in tv.terms.collect()} == {"red": 3, "ring": 3, "bolt": 2}
    assert (tv.rows, tv.entries, tv.row_entries, tv.shared_ids) == (7, 3, 8, False)
    # id 1 stands on two rows of one vector, so its entries stand there twice; no vector without copies takes part in a join
    assert sorted((r["id"], r["term"]) for r in row_weights(tv).collect() if r["id"] is not None) == [
        (1, "red"), (1, "red"), (1, "ring"), (1, "ring"), (2, "bolt"), (3, "red"), (3, "ring")]
    assert [r["term"] for r in row_weights(tv).where("id is null").collect()] == ["bolt"]


def test_an_id_on_two_strings_has_one_vector_of_both(spark):
    rows = spark.createDataFrame([(1, "red ring"), (1, "blue ring"), (2, "red bolt")], "id long, string string")
    tv = term_vectors(rows)
    names = {r["rank"]: r["term"] for r in tv.terms.collect()}
    got = {r["vec"]: sorted(names[t] for t in r["terms"]) for r in tv.vectors.collect()}
    assert got == {1: ["blue", "red", "ring"], 2: ["bolt", "red"]}


def test_pairs_that_share_little_are_dropped_before_their_vectors_are_read(spark):
    # every two rows share a rare word but no common one, so one shared listed word alone tells nothing
    rows = frame(spark, [f"k{i // 2} " + " ".join(f"own{i}x{j}" for j in range(8)) for i in range(40)] + ["near copy of some words", "near copy of some word"])
    kept = {(r["a"], r["b"]) for r in neighbours.candidate_pairs(term_vectors(rows).vectors, 0.9).collect()}
    assert kept == {(40, 41)}
