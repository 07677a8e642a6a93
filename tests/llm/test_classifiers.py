"""Scores on held-out folds, base counts against brute force, and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringloom.llm import languages, neighbours, rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(-1, None, "en"), (-2, "", None), (-3, " \n", "en"), (-4, "123 !!", "fr"), (None, "der und die", None), (-5, "x" * 100_000, "de"), (-6, "the of " * 30_000, "en")]


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def tables(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(ODD + ODD[:2], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd).withColumns({"score": F.lit("clash"), "label": F.lit(7), "ratios": F.lit(0)})
    labels = spark.read.parquet(f"{base}/labels.parquet")
    loose = spark.createDataFrame([(None, 1, 1), (-1, None, 1), (-99, 0, 0), (0, 5, 5)], labels.schema)
    return docs, labels.unionByName(loose)


def truth(labels, column):
    return {r["doc_id"]: r[column] for r in labels.where(f"doc_id >= 0 AND {column} IN (0, 1)").collect()}


@pytest.mark.parametrize("operator,column,n,k,least", [(neighbours.quality_scores, "quality", 3, 1, 0.95), (toxicity.toxicity_scores, "toxic", 5, 0, 0.9)])
def test_scores_hold_out_of_fold(tables, operator, column, n, k, least):
    docs, labels = tables
    got = operator(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and bucket(r["doc_id"], n) == k)
    known = truth(labels, column)
    right = [r["predicted"] == known[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in known]
    assert np.mean(right) >= least


@pytest.mark.parametrize("operator", [neighbours.quality_scores, toxicity.toxicity_scores])
def test_scores_do_not_depend_on_held_out_labels(tables, operator):
    docs, labels = tables
    n, k = (3, 1) if operator is neighbours.quality_scores else (5, 0)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
    turned = labels.withColumns({c: F.when(fold == k, 1 - F.col(c)).otherwise(F.col(c)).cast("int") for c in ("quality", "toxic")})
    score = lambda x: {(r["doc_id"], r["score"]) for r in operator(docs, x).select("doc_id", "score").collect()}
    assert score(labels) == score(turned)


def sentences(n, seed=5):
    rng = np.random.default_rng(seed)
    names = np.array("river stone bread lamp winter garden copper thread sailor museum".split())
    return [" ".join(rng.choice(names, rng.integers(3, 30))) + "." for _ in range(n)]


def test_quality_terms_see_words():
    shifted = str.maketrans("abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza")
    text = sentences(1)[0]
    one, other = (neighbours.term_matrix(pa.array([x])) for x in (text, text.translate(shifted)))
    assert not set(one.columns[one.columns >= neighbours.MANNER]) & set(other.columns[other.columns >= neighbours.MANNER])


def test_latent_space_and_votes_equal_brute_force():
    texts = sentences(60) + ["", None, "zzz"]
    terms = neighbours.term_matrix(pa.array(texts))
    assert len(neighbours.term_matrix(pa.array([], pa.string()))) == 0
    back = neighbours.unpacked_terms(*(x.to_pylist() for x in neighbours.packed_terms(terms)))
    assert all(np.array_equal(getattr(back, c), getattr(terms, c)) for c in ("first", "columns", "values"))
    labels = np.arange(len(texts)) % 2
    voters = neighbours.fit_voters(terms, labels, dimensions=6)
    dense = np.zeros((len(texts), neighbours.TERMS))
    weighed = terms.weighed(voters.weight)
    dense[weighed.rows(), weighed.columns] = weighed.values
    _, exact, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(np.linalg.norm(dense @ voters.space, axis=0)[:4], exact[:4], rtol=0.02)
    place = dense @ voters.space
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-30)
    for r, score in enumerate(voters.scores(terms, neighbours=5)):
        cosines = place[r] @ place.T
        near = sorted(range(len(texts)), key=lambda i: (-round(cosines[i], 5), i))[:5]
        weight = np.maximum(cosines[near], 0)
        want = (weight * labels[near]).sum() / weight.sum() if weight.sum() > 0 else labels.mean()
        assert abs(score - want) < 1e-3 or np.isclose(np.sort(cosines)[-5], np.sort(cosines)[-6], atol=1e-4)


def test_ties_go_to_earlier_labelled_rows():
    space = np.zeros((neighbours.TERMS, 1), np.float32)
    space[:, 0] = 1
    voters = neighbours.Voters(np.ones(neighbours.TERMS, np.float32), space, np.ones((4, 1), np.float32), np.array([1.0, 1.0, 0.0, 0.0]), 0.5)
    terms = neighbours.term_matrix(pa.array(["one two", "", "many words here"]))
    assert voters.scores(terms, neighbours=2).tolist()[::2] == [1.0, 1.0] and np.allclose(voters.scores(terms, neighbours=4)[::2], 0.5)


def test_languages_out_of_fold(tables):
    docs, _ = tables
    got = languages.languages(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (-1, -2, -3, -4)] == ["und"] * 4 and by_id[None]["lang_pred"] == "de"
    known = {r["doc_id"]: r["lang"] for r in docs.where("doc_id >= 0").collect()}
    right = [r["lang_pred"] == known[r["doc_id"]] for r in got if r["held_out"] and (r["doc_id"] or -1) >= 0]
    assert np.mean(right) >= 0.98 and all(0 <= r["score"] <= 1 for r in got)


def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_and_verdicts(spark, tables, noisy_docs):
    docs, labels = tables
    got = rules.quality_rules(docs, labels).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        counts = base_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in rules.COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and not (r["base_failed"] and r["kept"])
    known = truth(labels, "quality")
    judged = [(known[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in known and not r["base_failed"]]
    assert np.mean([k for q, k in judged if q == 1]) >= 0.98 and np.mean([k for q, k in judged if q == 0]) <= 0.2
    rows = spark.createDataFrame(noisy_docs, "doc_id long, text string")
    want = sorted(base_counts(t) for _, t in noisy_docs)
    assert sorted(tuple(r[c] for c in rules.COUNTS) for r in rules.rule_statistics(rows).collect()) == want


def test_chain_equals_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 12])
    emission, moves = rng.normal(size=12) * 2, np.exp(rng.normal(size=(2, 2)))
    got, _, _ = toxicity.chain(emission, first, moves)
    for a, b in zip(first[:-1], first[1:]):
        total, on = 0.0, np.zeros(b - a)
        for state in range(1 << (b - a)) if b > a else []:
            bits = np.array([state >> i & 1 for i in range(b - a)])
            weight = np.exp((bits * emission[a:b]).sum()) * np.prod([moves[x, y] for x, y in zip(bits[:-1], bits[1:])])
            total, on = total + weight, on + weight * bits
        assert np.allclose(got[a:b], on / total if b > a else on)


def test_long_toxic_documents_are_learnt(spark):
    rng = np.random.default_rng(3)
    calm = lambda n: " ".join(rng.choice(["tea", "road", "cloud", "paper", "green", "walk"], n))
    rows = [(i, calm(60) if i % 2 else f"{calm(2_500)} vile {calm(2_500)} vile"[: 40_000] if i % 10 else f"{calm(20)} vile brute") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    assert min(len(t) for i, t in rows if i % 2 == 0 and i % 10) > 20_000
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert np.mean([got[i] == 1 - i % 2 for i in got]) >= 0.97
    one_sided = toxicity.toxicity_scores(docs, labels.where("toxic = 0"))
    assert {r["predicted"] for r in one_sided.collect()} == {0}
    bounded = toxicity.fitted_field(docs, labels, characters=1)
    assert len(set(bounded.scores(np.zeros(0), np.zeros(3, dtype=int)))) == 1


def test_passages_cover_all_words():
    first = np.array([0, 0, 3, 1_600, 1_600, 2_112])
    cuts = toxicity.passages(first)
    assert set(first) <= set(cuts.tolist()) and (np.diff(cuts) > 0).all() and np.diff(cuts).max() <= toxicity.PASSAGE


def test_spans_mark_toxic_words(tables):
    docs, labels = tables
    found = Counter()
    for r in toxicity.toxic_spans(docs, labels).join(docs.select("doc_id", "text").distinct(), "doc_id").where("size(spans) > 0").collect():
        found.update(r["text"].lower()[s["start"]:s["end"]] for s in r["spans"])
    assert {"idiot", "moron", "trash"} <= set(found)


@pytest.mark.parametrize("operator", [neighbours.quality_scores, toxicity.toxicity_scores, rules.quality_rules])
def test_empty_tables(spark, tables, operator):
    docs, labels = tables
    assert operator(docs.where("false"), labels).count() == 0
    assert operator(docs.limit(5), labels.where("false")).count() == 5
    assert languages.languages(docs.where("false")).count() == 0


@pytest.mark.parametrize("bound", [0, 50])
def test_the_limit_of_the_rules_comes_from_all_labelled_rows(tables, bound):
    docs, labels = tables
    forest = rules.fitted_forest(docs, labels, bound)
    known, rows = truth(labels, "quality"), {}
    for r in rules.rule_statistics(docs).where(~rules.base_failed()).collect():
        if r["doc_id"] in known:
            rows[r["doc_id"]] = r["ratios"]
    assert len(rows) > 100
    scores, label = forest.scores(np.array(list(rows.values()))), np.array([known[i] for i in rows])
    kept, bad = scores[label == 1], scores[label == 0]
    floor = np.quantile(kept, 0.995, method="higher")
    limits = np.unique(np.concatenate([bad[bad > floor], [floor]]))
    gain = [(bad > x).mean() - 10 * (kept > x).mean() for x in limits]
    assert forest.limit == pytest.approx(limits[int(np.argmax(gain))], abs=1e-12) and max(gain) > 0
    alone = rules.fitted_forest(docs, labels.where("quality = 1"), bound)
    assert alone.limit == 1.0 and len(alone.trees) == 200
