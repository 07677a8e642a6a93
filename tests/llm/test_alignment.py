"""Aligned tokens against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stringloom.llm import alignment as al


@pytest.fixture(scope="module")
def tools():
    byte = Tokenizer.from_file(al.BYTE_MODEL)
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=al.PIECE_MODEL)


def plain(texts, tools):
    """Contract columns of every text, token by token."""
    byte, piece = tools
    letters = al._byte_letters()
    spans, links = [], []
    for t in texts:
        a = b = []
        if t:
            a, b = byte.encode(" " + t, add_special_tokens=False).ids, piece.encode(t)
            ab = [bytes(letters[c] for c in byte.id_to_token(i)) for i in a]
            bb = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
                a = b = []
        if not a:
            spans.append(([], [], []))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (ab, bb)]
        common = sorted(set(ends[0]) & set(ends[1]))
        spans.append((a, b, [([i for i, e in zip(a, ends[0]) if lo < e <= hi], [j for j, e in zip(b, ends[1]) if lo < e <= hi])
                             for lo, hi in zip([0, *common], common)]))
        begins = [[0, *e[:-1]] for e in ends]
        links.append([(i, j) for i, s, e in zip(a, begins[0], ends[0]) for j, u, v in zip(b, begins[1], ends[1]) if u < e and s < v])
    docs = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    out = []
    for (a, b, groups), own in zip(spans, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(own), sum(docs[p] == most[p[0]] for p in own), sum(docs[p] for p in own),
                    hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


def odd_texts():
    rng = random.Random(5)
    signs = ["the", " The", "naïve", "日本語", "😀", "\n", "\t\t", "  ", "12345", "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", " ", "\x01", "ﬁ", "é",
             " ", "Ω", "--", "xyzzyx", "…", "\x85", "\x1c", "a", "ع", "ि"]
    made = ["".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [None, "", " ", "a", "▁", "a▁b", "<|endoftext|>", "\x00", "a" * 5000, " " * 5000, "\n" * 3000, "word " * 4000, *made, *made[:3]]


def test_equals_plain_walk(spark, tools):
    texts = odd_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 as a_ids", "2 as pair", "3 as overlaps").repartition(5)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
           for r in al.alignment_digest(frame).collect()}
    assert got == dict(enumerate(plain(texts, tools)))
    assert got[0] == (0, 0, 0, 0, 0, 0, "")


def test_blocks_and_held_counts_change_nothing(spark, tools, monkeypatch):
    texts = odd_texts()[12:80]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(al, "BLOCK", 100)
    got = sorted(al.alignment_digest(frame).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_best"], r["count_sum"]) for r in got] == [(x[4], x[5]) for x in plain(texts, tools)]


def test_both_byte_level_implementations_agree(tools):
    pair = al.Pair(al.load_files())
    texts = [f"x{chr(c)}{chr(c)} {chr(c)}y {chr(c)}1" for c in [*range(1, 0x3000), *range(0xA000, 0xD7FF, 7), *range(0xE000, 0x11000), *range(0x1D400, 0x1F900, 5)]]
    slow = [x.ids for x in tools[0].encode_batch(texts, add_special_tokens=False)]
    assert [t for t, s in zip(texts, slow) if pair.a_ids(t).tolist() != s] == []


def test_gallop_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(1, 500, rng.integers(1, 60)))
        b = np.unique(np.append(rng.integers(1, 500, rng.integers(1, 400)), a[-1]))
        b = b[b <= a[-1]]
        ends = np.concatenate([a, b])
        one = lambda x: np.array([x])
        found = al.gallop(ends, one(0), one(len(a)), one(len(a)), one(len(ends)))
        assert (found[:len(a)] - len(a)).tolist() == np.searchsorted(b, a).tolist()


def test_empty_table_and_rows_without_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert al.alignment_digest(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_a"] for r in al.alignment_digest(rows).collect()) == [0, 2, 2]


def test_general_output(spark, tools):
    texts = odd_texts()[12:30]
    got = sorted(al.alignment(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])
    for r, t, want in zip(got, texts, plain(texts, tools)):
        assert len(r["a_ids"]) == len(r["overlaps"]) == len(r["closes"]) == want[0] and sum(r["overlaps"]) == want[3] and sum(r["closes"]) == want[2]
        assert r["b_ids"] == (tools[1].encode(t) if want[0] else [])


def test_parts_change_nothing(spark, tools, monkeypatch):
    monkeypatch.setattr(al, "AT_ONCE", 50)
    texts = odd_texts()[:60]
    rows = al.alignment_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == plain(texts, tools)
