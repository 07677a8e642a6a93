"""The pipeline's stages one after the other, against their operators' own decisions."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from stringloom.llm import decontaminate, minhash, pieces, pii, rules
from stringloom.llm.runtime import table, written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs, docs := written(stage(spark, docs, sf), name)))
    return out


def ids(frame, where="true"):
    return sorted(r["doc_id"] for r in frame.where(where).select("doc_id").collect())


def test_stages_keep_the_columns(spark, sf, stages):
    columns = table(spark, sf, "documents").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "personal_data", "tokens"]
    assert all(after.columns == columns for _, after in stages[:-1])
    assert all(before.exceptAll(before.dropDuplicates()).count() == 0 for before, _ in stages)


def test_decisions_take_effect(spark, sf, stages):
    (raw, good), (_, unlike), (_, clean), (_, hidden), (_, tokens) = stages
    labels, items = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    assert ids(good) == ids(rules.quality_rules(raw, labels), "kept")
    assert ids(unlike) == ids(minhash.near_duplicates(good), "kept")
    leaked = {r["doc_id"] for r in decontaminate.benchmark_hits(unlike, items).collect()}
    assert ids(clean) == [i for i in ids(unlike) if i not in leaked] and leaked
    found = pii.personal_data(clean).where("size(base) + size(extra) > 0")
    assert ids(found) == ids(clean.join(hidden.select("doc_id", F.col("text").alias("now")), "doc_id"), "text <> now")
    assert pii.personal_data(hidden).where("size(base) > 0").count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r["doc_id"]: r["text"] for r in hidden.collect()}
    got = {r["doc_id"]: r["ids"] for r in tokens.collect()}
    assert got == {i: library.encode(t) for i, t in texts.items()}


def test_odd_rows_pass_every_stage(spark, sf):
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 50_000, None, "s", 1), (None, "a b", "x", "y", 3)]
    docs = table(spark, sf, "documents")
    rows = spark.createDataFrame(odd, docs.schema).unionByName(docs.limit(20)).withColumns({"kept": F.lit("clash"), "key": F.lit(1), "base": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, sf).count() <= rows.count()
        assert stage(spark, rows.where("false"), sf).count() == 0


def test_stages_with_columns_named_like_their_own_helpers(spark):
    from stringloom.llm import minhash
    base = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, base, "a", 5, 6), (2, base + " more", "b", 7, 8), (3, "yes it is so", "c", 9, 1), (None, None, "d", 2, 3)],
                                 "doc_id long, text string, _text_hash string, _dropped_id long, _bad_id long")
    once = minhash.one_of_each(docs)
    assert once.columns == docs.columns and sorted(r["_text_hash"] for r in once.collect()) == ["a", "c", "d"]
    items = spark.createDataFrame([(1, "yes"), (2, " ".join(f"word{i}" for i in range(5, 30)))], "item_id long, text string")
    kept = decontaminate.without_benchmark(docs, items, least_words=decontaminate.EVIDENCE)
    assert kept.columns == docs.columns and sorted(r["_text_hash"] for r in kept.collect()) == ["c", "d"]
    assert {r["doc_id"] for r in decontaminate.benchmark_hits(docs, items).collect()} == {1, 2, 3}  # the short item is reported all the same
