"""Personal data against a brute-force version on made-up texts, and the learnt patterns on a planted wording."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stringloom.llm import pii

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def made_up(rng):
    bits = ["a.b@c.d", "é@x.y", "x@y", "@", "..", ".", "_", "%", "+", "+1 (234) 555-0199", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111",
            "4111111111111111", "41111111-11111111", "12", " ", "-", "é", "\n", "a-b.c-d", "ü1", "9" * 25, "(", "+49 30 1234567", "5", "--", "𝒳"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [made_up(rng) for _ in range(1500)] + [None, "", "1" * 50_000, "a" * 50_000, "1 " * 5_000, "a@" * 3_000, "x." * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in pii.personal_data_digest(rows).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), repr(text)
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want.split(",")) for k in KINDS]


def test_wording_reveals_identifiers_and_clean_text_stays(spark):
    rows = [(i, f"so it is, phone: +1 (234) 555-{1000 + i} and more") for i in range(12)]
    rows += [(100, "call now, phone: 0234-5550123 today"), (101, "version 20240101 of the house"), (102, None), (None, "phone: 0234-5550199")]
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, value string, cue string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data_digest(docs).collect()}
    assert got[100] == "phone:17:29" and got[None] == "phone:7:19"
    assert got[101] == "" and got[102] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert clean[100] == "call now, phone: <PHONE> today" and clean[0] == "so it is, phone: <PHONE> and more"
    assert clean[101] == rows[13][1] and clean[102] is None


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert pii.personal_data_digest(none).count() == 0
    assert pii.redacted(none).columns == ["doc_id", "text", "n_chars"]


def test_no_python_in_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = pii.redacted(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.redacted(docs).where(F.length("text") != F.col("n_chars")).count() == 0


def test_glued_wording_and_shapes_of_each_kind(spark):
    seeds = [(i, f'GET tel=+1 (234) 555-{1000 + i} {{"mail":"a{i}@x.example","phone":"+1 (234) 556-{1000 + i}"}} write to: b{i}@y.example or call: +1 234 557 {1000 + i}') for i in range(12)]
    more = {100: "got tel=0234-5550123 here", 101: '{"phone":"0234 555 0199","mail":"jane.doe@intranet"}', 102: "write to: jane(at)example.com or call: 0234 555 0199 now",
            103: "write to: Jane.Doe [at] example [dot] com", 104: "on 12 345 678 of jane@intranet", 105: "write to: 0234 555 0199", 106: '"phone":0234-5550123, tel=1'}
    docs = spark.createDataFrame(seeds + list(more.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data_digest(docs).collect()}
    marked = {d: [(k, more[d][int(a):int(b)]) for k, a, b in (x.split(":") for x in got[d].split(",") if x)] for d in more}
    assert marked == {100: [("phone", "0234-5550123")], 101: [("phone", "0234 555 0199"), ("email", "jane.doe@intranet")],
                      102: [("email", "jane(at)example.com"), ("phone", "0234 555 0199")], 103: [("email", "Jane.Doe [at] example [dot] com")], 104: [], 105: [], 106: []}
    assert all(got[i].count(":") == 10 for i, _ in seeds)


def test_many_matches_in_one_text_take_time_in_proportion(spark):
    import time
    line = "user{0}@example.com from 10.0.{1}.{2} id 99{0:06d} at +1 (234) 555-{3:04d}; "
    text = "".join(line.format(i, i % 256, i % 200, i % 10_000) for i in range(17_500))
    assert len(text) > 1_000_000
    docs = spark.createDataFrame([(1, text), (2, "a@b.c")], "doc_id long, text string")
    begun = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.personal_data_digest(docs).collect()}
    taken = time.perf_counter() - begun
    assert got[1]["base_sha256"] == hashlib.sha256(brute(text).encode()).hexdigest()
    assert got[1]["n_email"] == got[1]["n_ip"] == got[1]["n_phone"] == 17_500
    assert taken < 60, taken
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}[1]
    assert clean.count("<EMAIL>") == clean.count("<IP>") == clean.count("<PHONE>") == 17_500 and "@" not in clean


def test_clashing_columns_and_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "x 1.2.3.4@b.c y +1 234 567 8901.2.3.4 z", 5, 6, 7, 8)], "doc_id long, text string, _span_id long, _span_hash long, _spans long, span_id long")
    got = pii.redacted(docs)
    assert got.columns == docs.columns and got.first()[2:] == (5, 6, 7, 8)
    assert got.first()["text"] == "x <EMAIL> y <PHONE> z"


def test_characters_used_as_marks_stay_in_place(spark):
    text = "﷐ a@b.c ﷑﷒ 1.2.3.4"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.personal_data_digest(docs).first()["spans"] == brute(text)
    assert pii.redacted(docs).first()["text"] == "﷐ <EMAIL> ﷑﷒ <IP>"
