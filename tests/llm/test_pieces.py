"""Encoding against the library that reads the same model, decoding as an exact round trip."""

import random

import pytest
import sentencepiece

from stringloom.llm import pieces


@pytest.fixture(scope="module")
def texts(noisy_docs):
    rng = random.Random(1)
    letters = "abcdefghij  klmnopqrstuvwxyzABC.,()1290\n'éüñß🙂\t日本"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return made + [t for _, t in noisy_docs] + ["", None, " ", "  a  b ", "\n\n\t x", "🙂🙂", "\0 nul", "aaaaaaaaaaaaaaaa", " " * 9, "x" * 20_000, "é" * 50, "�"]


def test_ids_equal_the_library_and_decode_back(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", [7]) for i, t in enumerate(texts)], "doc_id long, text string, number string, ids array<int>").repartition(5)
    got = {r["doc_id"]: r for r in pieces.with_decoded(pieces.encoded(docs)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i]["ids"] == (library.encode(text) if text else []), repr(text)
        assert got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["decoded"] == (text or "") and got[i]["number"] == "clash"


def test_forgetting_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_WORDS", 50)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 64)
    vocabulary = pieces.load_vocabulary()
    forgetful = pieces.Encoder(vocabulary)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for k in range(0, 600, 100):
        ids, sizes = forgetful.encode(texts[k:k + 100])
        assert ids.tolist() == [x for t in texts[k:k + 100] for x in library.encode(t)] and sizes.sum() == len(ids)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.with_decoded(pieces.encoded(none)).columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    assert pieces.with_decoded(pieces.encoded(none)).count() == 0
