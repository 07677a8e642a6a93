"""Benchmark hits against a brute-force edit distance, and the pipeline's decisions against the operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stringloom.llm import decontaminate


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def best(item, text):
    """Least edit distance of ``item`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "Été", "naïve"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randint(5, 40))) for i in range(25)]
    docs = []
    for i in range(150):
        own = text(rng.randint(0, 60))
        if rng.random() < 0.7:
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(copy) // 3))):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], "new"]])
            at = rng.randint(0, len(own))
            own[at:at] = copy
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in own)))
    docs += [(500, None), (501, ""), (None, " ".join(items[3][1])), docs[0]]
    return docs, [(i, " - ".join(t)) for i, t in items] + [(90, None), (91, ""), (None, "w1 " * 20), (92, "the of")]


def test_hits_equal_brute_force(spark, cases):
    docs, items = cases
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(4)
    got = decontaminate.benchmark_hits(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for d, text in docs:
        for i, item in items:
            m = words_of(item)
            if i is not None and len(m) >= decontaminate.MIN_WORDS:
                errors = best(m, words_of(text))
                if errors <= int(len(m) * decontaminate.BUDGET + 1e-9):
                    want.append((d, i, errors))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    texts = {d: (t or "").lower() for d, t in docs}
    for r in got:
        part, item = words_of(texts[r["doc_id"]][r["start"]:r["end"]]), words_of(dict(items)[r["item_id"]])
        assert best(item, part) == r["distance"] and abs(len(part) - len(item)) <= r["distance"]


def test_blocks_of_items_change_nothing(spark, cases, monkeypatch):
    docs, items = cases
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((str(r), r) for r in decontaminate.benchmark_hits(frame, wanted).collect())
    once = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1_500)
    assert rows() == once


def test_clean_documents_stay(spark, cases):
    docs, items = cases
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.benchmark_hits(frame, wanted).collect()}
    kept = sorted(str(r["doc_id"]) for r in decontaminate.without_benchmark(frame, wanted).collect())
    assert kept == sorted(str(d) for d, _ in docs if d not in bad) and None in bad
    assert decontaminate.without_benchmark(frame.where("false"), wanted).count() == 0
    assert decontaminate.without_benchmark(frame, wanted.where("false")).count() == len(docs)


def test_myers_with_long_patterns():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 150))] for _ in range(2))
        assert min(decontaminate.myers(a, b)) == best(a, b) if b else True


def test_short_items_and_other_scripts(spark):
    items = [(1, "Who wrote Faust?"), (2, "水在什么温度下会沸腾并变成蒸汽"), (3, "The café’s owner – an old man – said “never again” to all of them"), (4, " ?! "), (5, "น้ำเดือด")]
    docs = [(1, "x. who wrote “Faust”? y"), (2, "who once wrote faust"), (3, "前文。水在什么温度下會沸腾并变成蒸汽？后文"), (4, "the café's owner - an old man - said \"never again\" to all of them"),
            (5, "?! 水在"), (6, "ถามว่าน้ำเดือดไหม")]
    got = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(1, 1, 0), (3, 2, 1), (4, 3, 0), (6, 5, 0)]
    texts = dict(docs)
    parts = {r["doc_id"]: texts[r["doc_id"]][r["start"]:r["end"]] for r in got}
    assert parts[3] == "水在什么温度下會沸腾并变成蒸汽" and parts[6] == "น้ำเดือด" and parts[1] == "who wrote “Faust"
