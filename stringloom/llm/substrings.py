"""Long passages that repeat across documents, by recompression (Jez 2016): equal substrings get equal interior symbols.

Round one names maximal runs of a word; every further round splits the symbols into left and right ones by a bit of their name and names each
neighbouring (left, right) pair. A name is a 64-bit hash of what it stands for, so it is the same in every task and no name table is needed.
With each symbol goes the range of words that its making depended on. Where a window covers such a range, every other document with
that window has the symbol too. So a window over the range of a symbol found in one document only repeats nowhere else; all other windows are
candidates and are compared by two hashes of their words. Nothing depends on luck: fewer shared symbols only mean fewer candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, written
from .words import Words, mixed, powers, sequence_hash, signed, window_hashes

WINDOW = 50
ROUNDS = 8
MARK = (1 << 31) - 1


def recompressed(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high) of the last round's symbols: their making depended on words low..high-1 only.

    ``first`` bounds the rows. At a row's edge the range reaches out of the row, so no window covers it.
    """
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(n, dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    size = (ends - starts).astype(np.uint64)
    names = np.where(size > 1, mixed(hashes[starts] + size * np.uint64(0xD6E8FEB86659FD93)), hashes[starts])
    row, low, high = row[starts], starts - 1, ends + 1  # a run ends where its neighbours differ
    far = np.int64(1) << np.int64(60)
    for level in range(1, rounds):
        right = (mixed(names + np.uint64(level * 0xA0761D6478BD642F % 2**64)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(names), dtype=bool)  # symbol i pairs with i + 1
        same = row[1:] == row[:-1]
        joins[:-1] = ~right[:-1] & right[1:] & same
        second = np.zeros(len(names), dtype=bool)
        second[1:] = joins[:-1]
        # what an unpaired symbol met on its open side also decided its fate; at an edge that is unknown
        met = np.where(right, np.arange(len(names)) - 1, np.arange(len(names)) + 1)
        inside = (met >= 0) & (met < len(names))
        met = np.clip(met, 0, len(names) - 1)
        inside &= row[met] == row
        new_low = np.where(inside, np.minimum(low, low[met]), -far)
        new_high = np.where(inside, np.maximum(high, high[met]), far)
        pair = np.flatnonzero(joins)
        renamed = names.copy()
        renamed[pair] = mixed(names[pair] * np.uint64(0x9FB21C651E98DF25) + names[pair + 1] + np.uint64(level))
        new_low[pair] = np.minimum(low[pair], low[pair + 1])
        new_high[pair] = np.maximum(high[pair], high[pair + 1])
        keep = ~second
        names, row, low, high = renamed[keep], row[keep], new_low[keep], new_high[keep]
    return names, low, high


def _symbols(rounds: int, window: int):
    """One row for each document: number of words, digest of its words, and the symbols whose range a window can cover."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            names, low, high = recompressed(words.hashes(), words.first, rounds)
            row = np.searchsorted(words.first, low, side="right") - 1
            fits = (high - low <= window) & (low >= 0)
            fits[fits] &= (low[fits] >= words.first[row[fits]]) & (high[fits] <= words.first[row[fits] + 1])
            pairs = np.unique(np.stack([row[fits], signed(names[fits])], axis=1), axis=0) if fits.any() else np.zeros((0, 2), np.int64)
            bounds = np.searchsorted(pairs[:, 0], np.arange(words.rows + 1))
            digests = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.counts(), pa.int64()), pa.array(digests),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pairs[:, 1], pa.int64()))],
                names=["doc_id", "n_words", "whole", "names"])
    return scan


def _candidates(rounds: int, window: int):
    """Windows of each row that cover no range of a symbol of this document alone."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            hashes = words.hashes()
            names, low, high = recompressed(hashes, words.first, rounds)
            row = np.clip(np.searchsorted(words.first, np.maximum(low, 0), side="right") - 1, 0, max(words.rows - 1, 0))
            fits = (high - low <= window) & (low >= 0)
            if len(low):
                fits &= (low >= words.first[row]) & (high <= words.first[row + 1])
            lists = batch.column(2).fill_null(pa.scalar([], pa.list_(pa.int64())))
            owner = np.repeat(np.arange(words.rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            known = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = lambda x, r: mixed(x + mixed(r.astype(np.uint64) + np.uint64(77)))
            alone = np.flatnonzero(fits)
            alone = alone[~np.isin(key(names[alone], row[alone]), key(known, owner))]
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, np.maximum(high[alone] - window, words.first[row[alone]]), 1)
            np.add.at(change, low[alone] + 1, -1)
            counts = np.maximum(words.counts() - window + 1, 0)
            starts = np.repeat(words.first[:-1], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = starts[np.cumsum(change)[:-1][starts] == 0]
            by_row = np.searchsorted(starts, words.first)
            one = signed(window_hashes(hashes, window))
            two = (window_hashes(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), window) >> np.uint64(33)).astype(np.int32)
            # a place also tells rows apart that share an id
            mark = (batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64) & MARK) << 32
            place = starts - np.repeat(words.first[:-1], np.diff(by_row)) + np.repeat(mark, np.diff(by_row))
            split = lambda x, kind: pa.ListArray.from_arrays(pa.array(by_row, pa.int32()), pa.array(x, kind))
            asked = pa.array(np.diff(by_row) > 0)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), split(place, pa.int64()), split(one[starts] if len(starts) else [], pa.int64()),
                 split(two[starts] if len(starts) else [], pa.int32())], names=["doc_id", "text", "places", "one", "two"])
            yield out.filter(asked)
    return scan


def _without(window: int):
    """Texts without the words of the listed windows; kept words joined by one space."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts, digests = [], [], []
            for text, places, key in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                words = (text or "").encode().split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.array(places or [], dtype=np.int64)
                at = at[at >> 32 == key & MARK] & ((1 << 32) - 1)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                texts.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                                             names=["doc_id", "whole", "n_removed", "kept_text"])
    return scan


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) for every row of ``docs``.

    A word goes when a window of ``window`` consecutive words over it also starts in a document with a smaller id; windows are judged on the
    input. ``kept_text`` is null where nothing goes, the text stays as it is then; ``kept_sha256`` is always that of the kept words joined by one
    space. Null and empty texts have no words. Rows that repeat an id count as one document. A row without an id neither loses words nor
    makes others lose them. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_words long, whole string, names array<long>"
    symbols = written(rows.mapInArrow(_symbols(rounds, window), schema), "symbols")
    plain = symbols.drop("names")
    # of documents with the same words only the first takes part; the others lose every word or, being short, none
    single = plain.where("doc_id IS NOT NULL AND n_words > 0").groupBy("doc_id").agg(F.min("whole").alias("whole"), F.max("whole").alias("other"))
    single = single.where("whole = other").select("doc_id", "whole")
    firsts = single.groupBy("whole").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copies = (single.join(firsts.where("first_id < last_id").select("whole", "first_id"), "whole").where("doc_id > first_id")
              .select("doc_id", F.lit(True).alias("copy")))
    copies = written(copies, "copies")

    own = symbols.where("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    postings = own.select("doc_id", F.explode("names").alias("name"))
    # written, so that the join below stands on plain exchanges and its hot keys are split at run time
    shared = postings.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name")
    shared = written(shared, "shared")
    of_doc = postings.join(shared, "name").groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    named = rows.where("doc_id IS NOT NULL AND text <> ''").join(of_doc, "doc_id", "left").join(copies, "doc_id", "left_anti")
    named = named.select("doc_id", "text", "names", F.xxhash64("text").alias("key"))
    met = named.mapInArrow(_candidates(rounds, window), "doc_id long, text string, places array<long>, one array<long>, two array<int>")
    met = written(met, "windows")

    each = met.select("doc_id", F.explode(F.arrays_zip("places", "one", "two")).alias("w")).select("doc_id", "w.*")
    first = each.groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    first = written(first, "first")
    gone = each.join(first, ["one", "two"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("places").alias("gone"))
    cut = (met.select("doc_id", "text").join(gone, "doc_id").select("doc_id", "text", "gone", F.xxhash64("text").alias("key")).mapInArrow(_without(window), "doc_id long, whole string, n_removed long, kept_text string"))
    cut = cut.dropDuplicates(["doc_id", "whole"]).withColumnRenamed("n_removed", "cut")
    all_of = plain.join(copies, "doc_id", "left").join(cut, ["doc_id", "whole"], "left")
    lost = F.col("copy") & (F.col("n_words") >= window)
    return all_of.select(
        "doc_id", "n_words",
        F.when(lost, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(lost, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(lost, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.sha2("kept_text", 256), F.col("whole"))).alias("kept_sha256"))
