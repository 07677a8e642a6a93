"""Documents that contain benchmark items, also with a few changed words: pigeonhole seeds and Myers verification.

Item and text are compared as normalised words (lower case, split at everything that is not a letter or digit; each character
of a script without spaces is a word). An item of m words may differ in e = floor(m *
``budget``) word edits. Cut in e + 1 pieces, at least one piece of it must stand unchanged in any such passage, so exact hits of pieces find every
candidate place; Myers' bit-parallel distance decides each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fresh_names, prepare
from .words import Words, signed, window_hashes

#: Share of an item's words that may be edited (none of fewer than five), and the fewest words an item needs to be searched at all.
BUDGET = 0.2
MIN_WORDS = 1
#: Words that an item needs for a filter of a corpus to remove the documents that contain it.
EVIDENCE = 8
#: Items are searched in blocks of at most this many characters (one scan of the texts for each block); it only bounds a broadcast.
BLOCK_CHARS = 4_000_000


def normal_words(column: pa.Array) -> Words:
    """Words of lower-cased texts; every ASCII character that is neither letter nor digit separates."""
    return Words(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), letters_only=True)


#: Scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana, ideographs.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3100, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
            (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def compared_words(column: pa.Array) -> Words:
    """Words of lower-cased texts; what is no letter, mark or digit separates, and characters of unspaced scripts stand alone. Places in code points stay."""
    lower = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    words = Words(pc.replace_substring_regex(lower, r"[^\p{L}\p{M}\p{N}\x00-\x7f]", " "), letters_only=True)
    data = words.data.astype(np.int64)
    three, four = np.flatnonzero((data >= 0xE0) & (data < 0xF0)), np.flatnonzero(data >= 0xF0)
    low = lambda at: data[at] & 0x3F
    code = np.concatenate([(data[three] & 0x0F) << 12 | low(three + 1) << 6 | low(three + 2),
                           (data[four] & 0x07) << 18 | low(four + 1) << 12 | low(four + 2) << 6 | low(four + 3)])
    begin, end = np.concatenate([three, four]), np.concatenate([three + 3, four + 4])
    alone = np.zeros(len(code), dtype=bool)
    for a, b in UNSPACED:
        alone |= (code >= a) & (code <= b)
    if alone.any():
        begin, end = begin[alone], end[alone]
        starts = np.union1d(words.starts, np.concatenate([begin, np.setdiff1d(end, words.ends)]))
        words.ends = np.union1d(words.ends, np.concatenate([end, np.setdiff1d(begin, words.starts)]))
        words.starts = starts
        words.first = np.searchsorted(words.starts, words.offsets)
    return words


@dataclass
class Seeds:
    """Pieces of all items by length: sorted hashes with the item and the offset each stands for."""

    items: list[tuple[int, np.ndarray, int]]  # id, word hashes, error budget
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def seeds(ids: list[int], texts: list[str], budget: float = BUDGET, min_words: int = MIN_WORDS) -> Seeds:
    words = compared_words(pa.array(texts, pa.string()))
    hashes = words.hashes()
    items, found = [], defaultdict(list)
    for r, item in enumerate(ids):
        own = hashes[words.first[r]:words.first[r + 1]]
        if len(own) < min_words:
            continue
        errors = int(len(own) * budget + 1e-9)
        cuts = np.linspace(0, len(own), errors + 2).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            found[b - a].append((window_hashes(own[a:b], b - a)[0], len(items), a))
        items.append((item, own, errors))
    pieces = {}
    for width, rows in found.items():
        rows.sort()
        pieces[int(width)] = (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Seeds(items, pieces)


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """Edit distance of ``pattern`` to the best part of ``text`` ending at each place (from the start of ``text`` if ``anchored``)."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = defaultdict(int)
    for i, x in enumerate(pattern):
        equal[x] |= 1 << i
    up, down, score, out = mask, 0, m, []
    for x in text:
        eq = equal.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        grow = down | (~(xh | up) & mask)
        shrink = up & xh
        score += bool(grow & high) - bool(shrink & high)
        grow = ((grow << 1) | (1 if anchored else 0)) & mask
        shrink = (shrink << 1) & mask
        up = (shrink | (~(xv | grow) & mask)) & mask
        down = grow & xv
        out.append(score)
    return out


def best_place(item: np.ndarray, errors: int, text: np.ndarray) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of ``text`` nearest to ``item``, or None beyond ``errors`` edits; ties go to the first end."""
    if np.isin(item, text).sum() < len(item) - errors:
        return None
    pattern = item.tolist()
    scores = myers(pattern, text.tolist())
    least = min(scores)
    if least > errors:
        return None
    end = scores.index(least) + 1
    back = myers(pattern[::-1], text[:end][::-1].tolist(), anchored=True)
    return least, end - 1 - back.index(least), end


def hits_in(words: Words, hashes: np.ndarray, known: Seeds) -> list[tuple[int, int, int, int, int]]:
    """(row, item id, distance, first word, end word) of each item found in each row, the nearest place of each item."""
    spots: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for width, (piece, item, offset) in known.pieces.items():
        windows = window_hashes(hashes, width)
        if not len(windows):
            continue
        at = np.flatnonzero(np.isin(windows, piece))
        row = np.searchsorted(words.first, at, side="right") - 1
        at, row = at[at + width <= words.first[row + 1]], row[at + width <= words.first[row + 1]]
        low, high = np.searchsorted(piece, windows[at], side="left"), np.searchsorted(piece, windows[at], side="right")
        for place, r, x, y in zip(at.tolist(), row.tolist(), low.tolist(), high.tolist()):
            for k in range(x, y):
                _, own, errors = known.items[item[k]]
                begin = place - int(offset[k]) - errors
                spots[r, int(item[k])].append((max(begin, int(words.first[r])), min(begin + len(own) + 2 * errors, int(words.first[r + 1]))))
    out = []
    for (r, k), ranges in sorted(spots.items()):
        item_id, own, errors = known.items[k]
        best = None
        for begin, end in sorted(set(ranges)):
            got = best_place(own, errors, hashes[begin:end])
            if got and (best is None or got[0] < best[0]):
                best = got[0], begin + got[1], begin + got[2]
                if not best[0]:
                    break
        if best:
            out.append((r, item_id, *best))
    return out


def _search(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = compared_words(batch.column(1))
            got = hits_in(words, words.hashes(), known.value)
            rows = pa.array([g[0] for g in got], pa.int64())
            start = words.character(words.starts[[g[3] for g in got]], [g[0] for g in got]) if got else []
            end = words.character(words.ends[[g[4] - 1 for g in got]], [g[0] for g in got]) if got else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                 pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "distance", "start", "end"])
    return scan


def benchmark_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", budget: float = BUDGET, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each item found in each document, at its nearest place.

    ``start`` and ``end`` are code points of the lower-cased text. Items are read in blocks of bounded size, each a broadcast and a scan of the texts.
    Null and empty texts contain nothing; items with fewer than ``min_words`` words (null and empty ones too) or without an id are not searched;
    repeated items and rows give repeated hits. Other columns are ignored whatever their names. Empty tables give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL")
    size = wanted.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = int(2 * size // BLOCK_CHARS) + 1
    schema = "doc_id long, item_id long, distance long, start long, end long"
    found = None
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b).orderBy("item_id", "item").collect()
        known = seeds([r["item_id"] for r in part], [r["item"] for r in part], budget, min_words)
        hits = rows.mapInArrow(_search(spark.sparkContext.broadcast(known)), schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def without_benchmark(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item of at least ``least_words`` words; all columns pass whatever their names.

    Ordinary texts hold short phrases by chance, so a filter passes EVIDENCE; ``benchmark_hits`` reports shorter items all the same. Rows without an id are judged on
    their own text too. Null and empty texts stay, very long ones are searched whole, empty tables of documents or items drop nothing.
    """
    bad, row = fresh_names(docs, "bad_id", "row")
    own, said = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    named, loose = docs.where(own.isNotNull()), docs.where(own.isNull())
    found = benchmark_hits(named, items, doc_id, text, min_words=least_words).select(F.col("doc_id").alias(bad)).distinct()
    kept = named.join(found, own.cast("long") == F.col(bad), "left_anti")
    flagged = benchmark_hits(loose.withColumn(row, F.xxhash64(said)), items, row, text, min_words=least_words).select(F.col("doc_id").alias(bad)).distinct()
    return kept.unionByName(loose.join(flagged, F.xxhash64(said) == F.col(bad), "left_anti"))
