"""Pairs of stored blocks: nothing is shuffled for the blocks that a row meets, and what is kept of their answers is whole."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.operators import neighbours, tiles
from stringloom.operators.vectors import term_vectors
from stringloom.plans.scratch import CLEANUP, dropped, written
from tests import brute


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors(spark, texts):
    return term_vectors(spark.createDataFrame(list(enumerate([*texts, ""])), "id long, string string")).vectors


@pytest.mark.parametrize(("dense", "eps", "rows"), [(0, 0.5, 7), (0, 1.2, 1_024), (float("inf"), 1.2, 1_024)])
def test_pairs_by_blocks_and_by_lists_equal_brute_force(vectors, texts, monkeypatch, dense, eps, rows):
    monkeypatch.setattr(neighbours, "DENSE", dense)
    monkeypatch.setattr(neighbours, "ROWS", rows)
    monkeypatch.setattr(neighbours, "PRODUCTS", 50)
    monkeypatch.setattr(tiles, "BLOCK", 13)
    found = neighbours.close_pairs(vectors, eps)
    assert ("CartesianProduct" in plan_of(found)) == (dense == 0)
    if dense == 0:
        assert "Exchange" not in plan_of(found)  # no candidate leaves its task
    got = {(r["a"], r["b"]): (r["dist"], r["copies_a"], r["copies_b"]) for r in found.collect()}
    assert all(a < b for a, b in got)
    first = {r["vec"]: r["copies"] for r in vectors.select("vec", "copies").collect()}
    d = brute.distances(brute.tfidf([*texts, ""]))
    want = {(a, b): d[a, b] for a in first for b in first if a < b and d[a, b] <= eps}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k]) < 1e-6 and got[k][1:] == (first[k[0]], first[k[1]]) for k in got)


def test_rows_are_not_shuffled_for_the_blocks_they_meet(vectors, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 13)
    monkeypatch.setattr(tiles, "ANSWERS", 10)  # answers are thinned out often
    found = neighbours.nearest_rows(vectors, 4)
    moved = plan_of(found).split("CartesianProduct")[1]
    assert "Exchange" not in moved and "Generate" not in moved
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.undo()
    assert [r[:2] for r in whole] == [tuple(r)[:2] for r in sorted(map(tuple, neighbours.nearest_rows(vectors, 4).collect()))]


def test_values_reach_the_rows_of_their_blocks(vectors, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 13)
    monkeypatch.setattr(tiles, "ROWS", 5)
    blocks = tiles.packed_sides(vectors.select("vec", "terms", "weights"))

    def compare(left, right, dots):
        return {"vec": left["vec"], "y": dots @ right["z"][:, 0] + left["z"][:, 1]}

    for most in (0, 1 << 20):  # joined, and broadcast
        monkeypatch.setattr(tiles, "SPREAD", most)
        joined = tiles.by_vec(blocks, vectors.select("vec", F.array(F.col("vec") + 1.0, F.lit(0.0)).alias("z")))
        got = {r["vec"]: r["y"] for r in tiles.meet_all(joined, compare, "vec long, y double", tiles.sums).groupBy("vec").agg(F.sum("y").alias("y")).collect()}
        rows = vectors.select("vec", "terms", "weights").collect()
        x = [dict(zip(r["terms"], r["weights"])) for r in rows]
        want = {r["vec"]: sum((s["vec"] + 1.0) * sum(w * x[j].get(t, 0.0) for t, w in x[i].items()) for j, s in enumerate(rows)) for i, r in enumerate(rows)}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_written_tables_leave_no_shuffle_files_and_can_be_dropped(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllBlocks().mkString(" ").split(" ") if x.startswith("shuffle")}
    before, conf = shuffled(), spark.conf.get(CLEANUP, "false")
    stored = written(spark.range(50_000).groupBy(F.col("id") % 5_000).count(), "counts")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert stored.count() == 5_000 and spark.conf.get(CLEANUP, "false") == conf
    dropped(stored)
    with pytest.raises(Exception):
        stored.collect()
