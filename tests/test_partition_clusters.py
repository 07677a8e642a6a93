import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.operators.clusters.kmeans import kmeans
from stringloom.operators.clusters.spectral import spectral_embedding
from stringloom.operators.clusters.ward import agglomerative
from stringloom.operators.vectors import term_vectors
from tests import brute


def labels_of(frame):
    return np.array([r["label"] for r in frame.orderBy("id").collect()])


def greedy_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                na, nb = len(groups[a]), len(groups[b])
                gap = x[groups[a]].mean(0) - x[groups[b]].mean(0)
                cost = na * nb / (na + nb) * float(gap @ gap)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    labels = np.zeros(len(x), dtype=int)
    for at, rows in enumerate(groups):
        labels[rows] = at
    return labels


@pytest.mark.parametrize("k", [4, 8])
def test_ward_equals_greedy_merging(spark, texts, k):
    unique = sorted(set(texts))
    frame = spark.createDataFrame(list(enumerate(unique)), "id long, string string")
    want = brute.partition(greedy_ward(brute.tfidf(unique), k))
    assert brute.partition(labels_of(agglomerative(frame, k))) == want


def fast_ward(x, copies, k):
    """The same merging by the update formula, for a thousand rows."""
    n, owner = copies.astype(float), np.arange(len(x))
    d = ((x[:, None, :] - x[None]) ** 2).sum(2) if len(x) < 200 else np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T)
    d = np.outer(n, n) / (n[:, None] + n[None]) * d
    np.fill_diagonal(d, np.inf)
    for _ in range(len(x) - k):
        i, j = sorted(divmod(int(np.argmin(d)), len(x)))
        price = d[i, j]
        with np.errstate(invalid="ignore"):
            row = ((n + n[i]) * d[i] + (n + n[j]) * d[j] - n * price) / (n + n[i] + n[j])
        row[i], row[np.isnan(row)] = np.inf, np.inf
        n[i] += n[j]
        d[j], d[:, j] = np.inf, np.inf
        row[j] = np.inf
        row[~np.isfinite(d.min(1))] = np.inf
        d[i], d[:, i] = row, row
        owner[owner == j] = i
    return owner


def test_ward_counts_copies(spark):
    texts = ["red ring"] * 3 + ["red ring gold", "blue bolt", "blue bolt", "blue bolt steel", "tin cup"] + ["tin cup big"] * 4
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, string string")
    assert brute.partition(labels_of(agglomerative(frame, 4))) == brute.partition(greedy_ward(brute.tfidf(texts), 4))


@pytest.mark.parametrize("group,listed", [(12, 12), (25, 3)])
def test_ward_in_many_groups_and_rounds(spark, texts, monkeypatch, group, listed):
    from stringloom.operators.clusters import ward
    monkeypatch.setattr(ward, "GROUP", group)
    monkeypatch.setattr(ward, "LISTED", listed)
    unique = sorted(set(texts))
    frame = spark.createDataFrame(list(enumerate(unique)), "id long, string string")
    assert brute.partition(labels_of(agglomerative(frame, 5))) == brute.partition(greedy_ward(brute.tfidf(unique), 5))


def test_ward_of_a_thousand_documents(spark):
    import duckdb
    rows = duckdb.sql("select min(text) from '/root/testdata/sf0.01/documents.parquet' group by list_sort(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))").fetchall()
    unique = sorted(r[0] for r in rows)
    frame = spark.createDataFrame(list(enumerate(unique)), "id long, string string")
    want = fast_ward(brute.tfidf(unique), np.ones(len(unique)), 8)
    assert brute.partition(labels_of(agglomerative(frame, 8))) == brute.partition(want)


def test_ward_of_one_row_and_of_equal_distances(spark):
    one = spark.createDataFrame([(1, "only one"), (2, "only one")], "id long, string string")
    assert labels_of(agglomerative(one, 3)).tolist() == [0, 0]
    apart = spark.createDataFrame([(i, f"w{i:02d}") for i in range(9)], "id long, string string")
    assert len(set(labels_of(agglomerative(apart, 4)).tolist())) == 4


def test_kmeans_rows_sit_at_nearest_centre(text_frame, texts):
    x, got = brute.tfidf(texts), labels_of(kmeans(text_frame, 6))
    centres = np.array([x[got == j].mean(0) for j in range(6)])
    gaps = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert np.all(gaps[np.arange(len(x)), got] <= gaps.min(1) + 1e-6)


def test_kmeans_counts_copies_and_settles(spark, texts):
    from stringloom.operators.clusters.kmeans import fitted_kmeans
    rows = texts + [texts[0]] * 30 + ["", "."]
    tv = term_vectors(spark.createDataFrame(list(enumerate(rows)), "id long, string string"))
    fitted = fitted_kmeans(tv, 5)
    assert all(b <= a + 1e-9 for a, b in zip(fitted.objective, fitted.objective[1:]))
    assert fitted.asked[-1] < fitted.asked[0] and len(fitted.objective) > 1
    x, got = brute.tfidf(rows), labels_of(kmeans(spark.createDataFrame(list(enumerate(rows)), "id long, string string"), 5))
    centres = np.array([x[got == j].mean(0) for j in range(5)])
    gaps = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert np.all(gaps[np.arange(len(x)), got] <= gaps.min(1) + 1e-6)
    assert abs(fitted.objective[-1] - gaps[np.arange(len(x)), got].sum()) < 1e-6


def test_kmeans_with_fewer_rows_than_clusters(spark):
    frame = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, "tin cup"), (4, "")], "id long, string string")
    assert labels_of(kmeans(frame, 6)).tolist() in ([a, a, b, c] for a in range(3) for b in range(3) for c in range(3) if len({a, b, c}) == 3)


def test_spectral_eigenvalues_equal_the_dense_ones(spark, text_frame, texts):
    embedded, values, residuals = spectral_embedding(term_vectors(text_frame).vectors, 5)
    w = np.exp(-brute.distances(brute.tfidf(texts)) ** 2)
    d = w.sum(1)
    want = np.sort(np.linalg.eigvalsh(w / np.sqrt(np.outer(d, d))))[::-1][:5]
    assert np.allclose(values, want, atol=1e-6)
    assert np.all(residuals <= 1e-3 * values)
    assert embedded.where(F.size("embedding") != 5).isEmpty()
    # the coordinates are eigenvectors of the random walk
    at = {r["vec"]: r["embedding"] for r in embedded.collect()}
    key = {t: i for i, t in reversed(list(enumerate(texts)))}
    names = sorted(at)
    m = (w / d[:, None])[np.ix_(names, names)] * np.array([sum(sorted(u.split()) == sorted(texts[v].split()) for u in texts) for v in names])
    v = np.array([at[n] for n in names])
    assert np.allclose(m @ v, v * values, atol=1e-3) and key


def test_tiles_of_any_size_give_the_same_neighbours(spark, texts, monkeypatch):
    from stringloom.operators import neighbours, tiles
    tv = term_vectors(spark.createDataFrame(list(enumerate([*texts, ""])), "id long, string string"))
    whole = sorted(map(tuple, neighbours.nearest_rows(tv.vectors, 4).collect()))
    monkeypatch.setattr(tiles, "ROWS", 17)
    cut = sorted(map(tuple, neighbours.nearest_rows(tv.vectors, 4).collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in cut] and np.allclose([r[2] for r in whole], [r[2] for r in cut])
    d = brute.distances(brute.tfidf([*texts, ""]))
    assert np.allclose([r[2] for r in whole], [d[r[0], r[1]] for r in whole], atol=1e-7)


def test_centres_are_met_where_a_vector_is_read(spark, texts, monkeypatch):
    from stringloom.operators.clusters import kmeans as km
    from stringloom.operators.vectors import term_vectors
    tv = term_vectors(spark.createDataFrame(list(enumerate(texts + ["", "solo"])), "id long, string string"))
    whole = km.fitted_kmeans(tv, 5)
    squares = km._squares(whole.centres, 5)
    found = km.centre_distances(tv.vectors, tv, whole.centres, squares)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    near = lambda f: {r["vec"]: [(e["c"], round(e["d2"], 9)) for e in r["near"]] for r in f.collect()}
    labels = lambda f: {r["vec"]: r["label"] for r in f.rows.collect()}
    want = near(found)
    # few held terms: the others are joined; and a full count in every round gives the same clusters as counting what changed
    monkeypatch.setattr(km, "COMMON", 5)
    assert near(km.centre_distances(tv.vectors, tv, whole.centres, squares)) == want
    cut = km.fitted_kmeans(tv, 5)
    assert labels(cut) == labels(whole) and cut.asked == whole.asked
    assert all(abs(a - b) < 1e-9 for a, b in zip(cut.objective, whole.objective))
    cells = lambda f: {(r["c"], r["term"]): r["x"] for r in f.centres.collect() if abs(r["x"]) > 1e-12}
    one, other = cells(whole), cells(cut)
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one)
    monkeypatch.setattr(km, "LIMIT", 0)
    assert near(km.centre_distances(tv.vectors, tv, whole.centres, squares)) == want


@pytest.mark.parametrize(("rows", "block"), [(1_024, 8_192), (7, 8_192), (7, 13)])
def test_a_pair_of_blocks_serves_both_directions(spark, texts, monkeypatch, rows, block):
    from stringloom.operators import tiles
    vectors = term_vectors(spark.createDataFrame(list(enumerate([*texts, ""])), "id long, string string")).vectors.select("vec", "terms", "weights")

    def every(left, right, dots):
        row, column = np.indices(dots.shape)
        return {"vec": left["vec"][row.ravel()], "to": right["vec"][column.ravel()], "dot": dots.ravel()}

    monkeypatch.setattr(tiles, "ROWS", rows)
    monkeypatch.setattr(tiles, "BLOCK", block)
    got = [sorted((r["vec"], r["to"], round(r["dot"], 9) + 0.0) for r in f.collect())
           for f in (tiles.meet_all(vectors, every, "vec long, to long, dot double"), tiles.meet(vectors, vectors, every, "vec long, to long, dot double"))]
    assert len(got[0]) == vectors.count() ** 2 and got[0] == got[1]


def test_a_row_meets_few_blocks(spark):
    from stringloom.operators import tiles
    rows = spark.range(200_000).select("id", F.array(F.col("id")).alias("terms"))
    assert tiles.blocks_for(rows) == 25  # not 196
    assert tiles.blocks_for(rows.limit(900)) == 1
