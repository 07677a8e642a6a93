"""Near-duplicate groups and repeated passages against brute force and SQL."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from catalog.compare import matches
from stringloom.llm import minhash, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    return docs.withColumns({"key": F.lit("k"), "root": F.lit(1), "n": F.lit(2), "sketch": F.lit("s"), "text_hash": F.lit(0)})


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def components_of(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_duplicates_equal_brute_force(spark, noisy_docs):
    want = components_of(noisy_docs)
    got = minhash.near_duplicates(frame(spark, noisy_docs)).collect()
    assert len(got) == len(noisy_docs)
    sizes = {i: len(shingles(t)) for i, t in noisy_docs}
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], sizes[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_strays_of_large_hubs_are_compared_in_blocks(spark, noisy_docs, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    want = components_of(noisy_docs)
    got = minhash.near_duplicates(frame(spark, noisy_docs)).where("doc_id IS NOT NULL").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_one_document_of_each_group_stays(spark, noisy_docs):
    want = components_of(noisy_docs)
    docs = frame(spark, noisy_docs)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if want[i] == i)
    assert ids.count(None) == 2


def without(rows):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k:k + 50])] = min(i, first.get(tuple(w[k:k + 50]), i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def test_repeated_passages_equal_brute_force(spark, noisy_docs):
    rows = noisy_docs + [(3, noisy_docs[0][1]), (55, None)]
    got = substrings.without_repeats(frame(spark, rows))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.drop("kept_text").collect()), key=key) == sorted(without(rows), key=key)
    texts = got.where("kept_text IS NOT NULL").select("kept_text", "kept_sha256").collect()
    assert texts and all(hashlib.sha256(r[0].encode()).hexdigest() == r[1] for r in texts)


@pytest.mark.parametrize("operator", [minhash.near_duplicates, minhash.one_of_each, substrings.without_repeats])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_equal_their_sql(spark, sf, duck, name):
    assert matches(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.SQL[name]).df()) is None
