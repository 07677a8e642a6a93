"""Vector codes against a full search in plain numbers; the registered query against SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

from catalog.compare import matches
from stringloom.llm import queries
from stringloom.llm import vector_codes as vc


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts if kept else 0
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(x) for x in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, label), e in zip(kept, errors):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, sums[label], digest) for (i, _, label), f, e in zip(kept, found, errors))


def listed(frame):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, size):
    centre = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(9)]
    rows = [(k, [c + rng.gauss(0, 0.2) for c in rng.choice(centre)], rng.choice([None, 0, 1, 2, 2, 2])) for k in range(n)]
    rows += [(n + k, rows[3][1], 5) for k in range(40)]  # copies: ties between entries of equal value
    rows += [(900, None, 1), (901, [None] * size, 1), (902, [math.nan] * size, 1), (903, [0.1] * (size - 1) + [math.inf], 0), rows[7], (None, rows[8][1], None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [16, 32, 64])
def test_equals_full_search(spark, size):
    rows = vectors(random.Random(size), 300, size)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as error", "'y' as same", "1 as rows", "2 as vector").repartition(5)
    assert listed(vc.vector_codes(frame)) == plain(rows)


def test_cells_leave_out_no_nearest_entry():
    rng = np.random.default_rng(2)
    for spread, size in ((4, 2), (60, 4), (500, 8), (5, 1)):
        books = vc.Codebooks(rng.integers(-spread, spread, (3, 40, size)))
        values = rng.integers(-2 * spread, 2 * spread, (700, 3 * size))
        for _ in range(2):  # once into an empty cache, once from it
            entry, distance = books.nearest(values)
            gaps = values.reshape(700, 3, 1, size) - books.entries[None]
            full = (gaps * gaps).sum(axis=3)
            assert (entry == full.argmin(axis=2)).all() and (distance == full.min(axis=2)).all()
        assert books.evaluated < 0.8 * 40 * books.met


def test_crowded_cache(monkeypatch):
    monkeypatch.setattr(vc, "CELLS", 4)
    rng = np.random.default_rng(5)
    books = vc.Codebooks(rng.integers(-50, 50, (2, 20, 3)))
    values = rng.integers(-99, 99, (400, 6))
    gaps = values.reshape(400, 2, 1, 3) - books.entries[None]
    assert (books.nearest(values)[0] == (gaps * gaps).sum(axis=3).argmin(axis=2)).all()


def test_few_rows_other_lengths_huge_components_and_empty_tables(spark):
    rows = [(1, [0.5] * 16, 1), (2, [-0.25] * 16, None), (3, [0.5] * 16, None)]
    odd = [(4, [0.5] * 17, 1), (5, [], 1), (6, [1.0] * 32, 7)]
    got = {r["vec_id"]: r for r in vc.vector_codes(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    want = {x[0]: x for x in plain(rows)}
    assert {str(k): (str(k), r["code"], r["error"]) for k, r in got.items() if k < 4} == {k: x[:3] for k, x in want.items()}
    assert [(got[k]["code"], got[k]["error"]) for k in (4, 5, 6)] == [(None, None)] * 3
    assert got[6]["label_error"] is None
    huge = spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)], SCHEMA)
    assert [r["error"] for r in vc.vector_codes(huge).collect()] == [0, 0, 0]
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf, duck):
    got = queries.op13_vector_codes(spark, sf).toPandas()
    assert matches(got, duck.sql(queries.SQL["op13_vector_codes"]).df()) is None
