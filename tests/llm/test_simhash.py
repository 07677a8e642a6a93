"""Fingerprint groups against all pairs on small tables."""

import random

import numpy as np
import xxhash

from stringloom.llm import simhash as sh


def plain_fingerprint(text):
    words, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in low:
        if c in " \t\n\v\f\r":
            words.append("")
        else:
            words = words or [""]
            words[-1] += c
    words = [w for w in words if w]
    lists = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64(" ".join(x).encode(), seed=42).intdigest() for x in lists]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                head[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{p:016x}", least.get(find(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))), key=repr)


def near_docs(rng, n):
    """Long texts with one changed word, so that many fingerprints differ in a few bits."""
    base = [[f"w{rng.randrange(3000)}" for _ in range(400)] for _ in range(8)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(["É", "x", "new"])
        out.append((1000 + i, " ".join(words)))
    return out


def test_equals_all_pairs(spark, noisy_docs):
    rows = noisy_docs + near_docs(random.Random(1), 120) + [(5000 + k, f"{k % 7} a") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bits", "2 as cell", "'x' as fingerprint").repartition(6)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in sh.simhash_groups(frame).collect()), key=repr)
    assert got == plain_groups(rows)
    assert any(f == "0" * 16 for _, f, _ in got)
    assert len({f for _, f, c in got}) > len({c for _, f, c in got})


def test_small_tiles_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    core = [rng.getrandbits(64) for _ in range(30)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in core for _ in range(30)} | {0, 1, (1 << 64) - 1}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "bits long")
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for tile, together in ((2048, 1 << 20), (2, 1 << 20), (7, 1)):
        monkeypatch.setattr(sh, "TILE", tile)
        monkeypatch.setattr(sh, "TOGETHER", together)
        got = {frozenset((r["a"], r["b"])) for r in sh.near_links(frame).collect()}
        assert got <= want
        assert parts(signed, got) == parts(signed, want)


def parts(nodes, links):
    head = {n: n for n in nodes}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in map(tuple, links):
        head[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(x) for x in out.values()}


def test_spark_hashes_alike(spark):
    texts = ["one two three", "É x", "a b", "||"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(lower(t))").collect()]
    assert [int(np.uint64(sh.shingle_hashes(t)[0]).astype(np.int64)) for t in ("one two three", "a b", "||")] == [got[0], got[2], got[3]]


def test_half_set_bits_and_chunks(monkeypatch):
    assert sh.fingerprint_of([0b11, 0b01]) == 1
    assert sh.fingerprint_of([]) == 0
    rng = random.Random(4)
    lists = [[rng.getrandbits(64) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    whole = sh._majorities(lists).tolist()
    monkeypatch.setattr(sh, "CHUNK", 3)
    assert sh._majorities(lists).tolist() == whole


def test_empty_table_and_only_empty_texts(spark):
    assert sh.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(2, None), (1, ""), (None, " ")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in sh.simhash_groups(rows).collect()) == [("1", 1), ("2", 1), ("None", 1)]
