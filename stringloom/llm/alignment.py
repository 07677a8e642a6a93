"""Alignment of two tokenizers' tokens by galloping intersection of their end offsets.

Both tokenizers cut the same bytes. The shorter list of end offsets drives: each of its ends is looked for in the longer list by steps that double
from the last place on and by binary search inside the last step. Ends that both lists have cut the tokens into groups; the ranks found for two
neighbouring ends give the range of the other list's tokens that a token overlaps.

Lists are searched in lanes: every ``LANE`` neighbouring ends of a driving list are one lane, which gallops on its own, and all lanes of a batch take
their steps together.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .runtime import prepare, written

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how a byte-level tokenizer with default splitting cuts a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unbroken runs from this length on go to the slower of two equal implementations, which has no limit on them.
LONG_RUN = 2_000
LANE = 64
#: Ids of both tokenizers stay below 2**BITS, so that a pair and its row fit one 64-bit number.
BITS = 20
#: Pairs whose counts a task holds before it hands them on, and pairs of one broadcast block. Neither bounds what is counted or looked up.
HELD = 2_000_000
BLOCK = 2_000_000
#: Bytes of text that a task aligns at once (a longer text alone); it only bounds memory.
AT_ONCE = 1 << 18


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Files:
    """Contents of the two vocabulary files, read on the driver."""

    byte_model: str
    piece_model: bytes


def load_files(byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> Files:
    with open(byte_model, encoding="utf-8") as a, open(piece_model, "rb") as b:
        return Files(a.read(), b.read())


class Pair:
    """Both tokenizers, the bytes of their tokens and the texts of their ids."""

    def __init__(self, files: Files):
        model = json.loads(files.byte_model)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        spelled = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(1 + max([*spelled, *special.values()]))]
        self.slow = Tokenizer.from_str(files.byte_model)
        self.slow.encode_special_tokens = True
        self.fast = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks={x: i for i, x in spelled.items()}, special_tokens={})
        self.long_run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.piece_model)
        n = self.pieces.get_piece_size()
        piece = self.pieces.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]
        if max(len(self.a_bytes), n) > 1 << BITS:
            raise ValueError(f"a vocabulary has more than {1 << BITS} ids")
        self.kind = _kind(max(len(self.a_bytes), n))
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.said = [f"{i}{mark}" for i in range(max(len(self.a_bytes), n)) for mark in (",", "|", ";", "")]

    def a_ids(self, text: str) -> np.ndarray:
        if self.long_run.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts by both tokenizers; none where the tokens' bytes are not a space and the text."""
        empty = np.zeros(0, dtype=np.int64)
        left, right = [empty] * len(texts), [empty] * len(texts)
        rows = [r for r, t in enumerate(texts) if t]
        for r, b in zip(rows, self.pieces.encode([texts[r] for r in rows], num_threads=1)):
            whole = (" " + texts[r]).encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                a = self.a_ids(" " + texts[r])
                if int(self.a_size[a].sum()) == len(whole):  # byte-level tokens are cuts of the text's bytes, so their lengths tell
                    left[r], right[r] = a, np.array(b, dtype=np.int64)
        return left, right


def gallop(ends: np.ndarray, begin: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each place of ``ends`` in some [begin, stop): the first place in [low, high) whose value is not below its own; -1 elsewhere.

    The lanes rise, and each one's last value is at most ``ends[high - 1]``.
    """
    found = np.full(len(ends), -1, dtype=np.int64)
    at, stop, low, high = begin.copy(), stop.copy(), low.copy(), high.copy()
    while len(at):
        target = ends[at]
        left, right = low.copy(), low.copy()
        live, size = np.flatnonzero(ends[right] < target), 1
        while len(live):  # double the step
            left[live] = right[live] + 1
            right[live] = np.minimum(right[live] + size, high[live] - 1)
            size *= 2
            live = live[ends[right[live]] < target[live]]
        live = np.flatnonzero(left < right)
        while len(live):  # halve what the last step passed
            middle = (left[live] + right[live]) // 2
            less = ends[middle] < target[live]
            left[live[less]] = middle[less] + 1
            right[live[~less]] = middle[~less]
            live = live[left[live] < right[live]]
        found[at] = low = right
        at = at + 1
        going = at < stop
        at, stop, low, high = at[going], stop[going], low[going], high[going]
    return found


def aligned_ids(a_size: np.ndarray, b_size: np.ndarray, a_rows: np.ndarray, b_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(overlaps, closes) for all left tokens: how many right tokens each overlaps, and whether a right token ends where it ends.

    ``a_size`` and ``b_size`` are byte lengths of all rows' tokens, ``a_rows`` and ``b_rows`` the numbers of tokens of each row; a row's tokens cover
    the same bytes on both sides.
    """
    n = len(a_size)
    ends = np.concatenate([np.cumsum(a_size), np.cumsum(b_size)])  # rows follow one another on both sides
    a_first, b_first = np.cumsum(a_rows) - a_rows, np.cumsum(b_rows) - b_rows + n
    by_a = a_rows <= b_rows
    drive, rows = np.where(by_a, a_first, b_first), np.where(by_a, a_rows, b_rows)
    other, others = np.where(by_a, b_first, a_first), np.where(by_a, b_rows, a_rows)
    lanes = -(-rows // LANE)
    row = np.repeat(np.arange(len(rows)), lanes)
    begin = drive[row] + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(begin + LANE, (drive + rows)[row])
    found = gallop(ends, begin, stop, other[row], (other + others)[row])
    at = np.flatnonzero(found >= 0)
    rank = found[at]
    hit = ends[rank] == ends[at]
    start = np.empty(len(at), dtype=np.int64)  # first token of the other list that reaches into this one
    start[1:] = (rank + hit)[:-1]
    used = rows > 0
    start[np.searchsorted(at, drive[used])] = other[used]
    count = rank - start + 1
    overlaps, closes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    mine = at < n
    overlaps[at[mine]], closes[at[mine]] = count[mine], hit[mine]
    start, count, rank, hit = start[~mine], count[~mine], rank[~mine], hit[~mine]
    reached = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    overlaps += np.bincount(reached, minlength=n)[:n].astype(np.int64)
    closes[rank[hit]] = True
    return overlaps, closes


def linked_pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_rows: np.ndarray, overlaps: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair) of every overlapping occurrence, pair = left id * 2**BITS + right id."""
    step = overlaps - 1 + closes  # how far the first overlapped right token moves; a row's steps add up to its right tokens
    right = np.repeat(np.cumsum(step) - step - (np.cumsum(overlaps) - overlaps), overlaps) + np.arange(int(overlaps.sum()))
    row = np.repeat(np.repeat(np.arange(len(a_rows)), a_rows), overlaps)
    return row, (np.repeat(a_ids, overlaps) << BITS) | b_ids[right]


def _kind(ids: int) -> np.dtype:
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


def _packed(flat: np.ndarray, rows: np.ndarray, kind: np.dtype) -> pa.Array:
    """Numbers of all rows as one binary value for each row."""
    offsets = (np.append(0, np.cumsum(rows)) * kind.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(kind))])


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each row has) of a packed column."""
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return np.frombuffer(whole.tobytes(), dtype=kind).astype(np.int64), np.diff(bounds) // kind.itemsize


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of about AT_ONCE bytes each."""
    sizes = np.array([len(x) if x else 0 for x in column.to_pylist()], dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // AT_ONCE
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return zip(bounds[:-1], bounds[1:])


def _aligned(docs: DataFrame, doc_id: str, text: str, byte_model: str, piece_model: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, marks) with packed lists; a mark is twice a left token's overlaps and one more where it closes a group."""
    spark = docs.sparkSession
    prepare(spark)
    files = spark.sparkContext.broadcast(load_files(byte_model, piece_model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files)
        for batch in batches:
            for begin, stop in _parts(batch.column(1)) if batch.num_rows else ():
                left, right = pair.encode(batch.column(1).slice(begin, stop - begin).to_pylist())
                a_rows, b_rows = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
                a, b = np.concatenate(left), np.concatenate(right)
                overlaps, closes = aligned_ids(pair.a_size[a], pair.b_size[b], a_rows, b_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, stop - begin), _packed(a, a_rows, pair.kind), _packed(b, b_rows, pair.kind),
                     _packed(2 * overlaps + closes, a_rows, pair.kind)], names=["doc_id", "a_ids", "b_ids", "marks"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, a_ids binary, b_ids binary, marks binary")


def alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """(doc_id, a_ids, b_ids, overlaps, closes) for every row of ``docs``.

    ``a_ids`` are the byte-level ids of a space and the text, ``b_ids`` the piece ids of the text. ``overlaps`` says for each left token how many right
    tokens share bytes with it, ``closes`` whether a right token ends with it. Null and empty texts, and texts whose tokens on either side do not
    spell a space and the text, have empty lists. Repeated rows give repeated results, rows without an id too; very long texts are taken whole. Other
    columns are ignored whatever their names. An empty table gives no rows.
    """
    packed = _aligned(docs, doc_id, text, byte_model, piece_model)
    files = docs.sparkSession.sparkContext.broadcast(load_files(byte_model, piece_model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = Lists(batch, _pair(files).kind)
                made = lambda flat, rows, kind: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rows)), pa.int32()), pa.array(flat, kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), made(lists.a_ids, lists.a_rows, pa.int32()), made(lists.b_ids, lists.b_rows, pa.int32()),
                     made(lists.overlaps, lists.a_rows, pa.int32()), made(lists.closes, lists.a_rows, pa.bool_())],
                    names=["doc_id", "a_ids", "b_ids", "overlaps", "closes"])

    return packed.mapInArrow(scan, "doc_id long, a_ids array<int>, b_ids array<int>, overlaps array<int>, closes array<boolean>")


_pairs: dict[int, Pair] = {}


def _pair(files) -> Pair:
    """One pair of tokenizers for each Python worker and broadcast."""
    if files.value is not None and id(files.value) not in _pairs:
        _pairs.clear()
        _pairs[id(files.value)] = Pair(files.value)
    return _pairs[id(files.value)]


class Lists:
    """Flat lists of a packed batch, how long each row's are, and its links."""

    def __init__(self, batch: pa.RecordBatch, kind: np.dtype):
        names = batch.schema.names
        (self.a_ids, self.a_rows), (self.b_ids, self.b_rows), (marks, _) = (_unpacked(batch.column(names.index(n)), kind) for n in ("a_ids", "b_ids", "marks"))
        self.overlaps, self.closes = marks >> 1, (marks & 1).astype(bool)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return linked_pairs(self.a_ids, self.b_ids, self.a_rows, self.overlaps, self.closes)

    def groups_text(self, said: list[str]) -> list[str]:
        """Each row's groups as text: left ids, a bar and right ids, groups parted by semicolons; empty without tokens."""
        step = self.overlaps - 1 + self.closes
        ends = np.zeros(len(self.b_ids), dtype=bool)  # right tokens that end a group
        ends[(np.cumsum(step) - 1)[self.closes]] = True
        group_a, group_b = (np.cumsum(c) - c for c in (self.closes, ends))
        a_done, b_done = np.flatnonzero(self.closes) + 1, np.flatnonzero(ends) + 1
        marks = np.where(ends, 2, 0)
        marks[(np.cumsum(self.b_rows) - 1)[self.b_rows > 0]] = 3
        codes = np.empty(len(group_a) + len(group_b), dtype=np.int64)
        codes[np.arange(len(group_a)) + np.append(0, b_done)[group_a]] = self.a_ids * 4 + self.closes
        codes[np.arange(len(group_b)) + (a_done[group_b] if len(group_b) else 0)] = self.b_ids * 4 + marks
        bounds = np.append(0, np.cumsum(self.a_rows + self.b_rows)).tolist()
        return ["".join(map(said.__getitem__, codes[x:y].tolist())) for x, y in zip(bounds[:-1], bounds[1:])]


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def _counted(files):
    """Rows that hold each pair, summed over what a task reads."""
    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "docs"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held, known = [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row, pair = Lists(batch, _pair(files).kind).links()
            own = np.unique((row << (2 * BITS)) | pair) & ((1 << 2 * BITS) - 1)  # once for each row
            keys, n = np.unique(own, return_counts=True)
            pairs.append(keys)
            counts.append(n)
            held += len(keys)
            if held > max(HELD // 2, 2 * known):
                pairs, counts = ([x] for x in _merged(pairs, counts))
                held = known = len(pairs[0])
                if held > HELD:
                    yield out(pairs[0], counts[0])
                    pairs, counts, held, known = [], [], 0, 0
        if pairs:
            yield out(*_merged(pairs, counts))
    return scan


def pair_counts(found: DataFrame, files) -> DataFrame:
    """(a_id, pair, docs, best) over all rows of a packed alignment: how many rows hold each pair linked, and whether no pair of its left id has more."""
    counts = (found.select("a_ids", "b_ids", "marks").mapInArrow(_counted(files), "pair long, docs long")
              .groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a_id", F.shiftright("pair", BITS)))
    counts = written(counts, "pairs")
    most = counts.groupBy("a_id").agg(F.max("docs").alias("most"))
    return written(counts.join(most, "a_id").select("a_id", "pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair_counts")


def _row_sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Exact sums by row, rows in order."""
    sums = np.append(0, np.cumsum(values))
    bounds = np.searchsorted(row, np.arange(rows + 1))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _scored(block, files, last: bool):
    """Adds a block's counts to n_best and count_sum; the ``last`` block's scan puts the digest columns in place of the lists."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = block.value
        own = _pair(files)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, columns = batch.num_rows, dict(zip(batch.schema.names, batch.columns))
            lists = Lists(batch, own.kind)
            row, pair = lists.links()
            n_links = np.bincount(row, minlength=n)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            met = pairs[at] == pair if len(pairs) else np.zeros(len(pair), dtype=bool)
            row, at = row[met], at[met]
            for name, more in (("n_best", np.bincount(row[best[at]], minlength=n)), ("count_sum", _row_sums(row, docs[at], n))):
                columns[name] = pa.array(columns[name].to_numpy(zero_copy_only=False) + more, pa.int64())
            if last:
                texts = lists.groups_text(own.said)
                owner = np.repeat(np.arange(n), lists.a_rows)
                columns = {"doc_id": columns["doc_id"], "n_a": pa.array(lists.a_rows), "n_b": pa.array(lists.b_rows),
                           "n_groups": pa.array(np.bincount(owner[lists.closes], minlength=n)), "n_links": pa.array(n_links),
                           "n_best": columns["n_best"], "count_sum": columns["count_sum"],
                           "groups_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts], pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return scan


def _blocks(counts: DataFrame) -> Iterator[tuple[tuple[np.ndarray, ...], bool]]:
    """(pair, docs, best) arrays of about BLOCK pairs, sorted by pair, with whole left ids each, and whether it is the last block."""
    blocks = max(1, -(-counts.count() // BLOCK))
    for k in range(blocks):
        rows = counts.where(F.pmod(F.xxhash64("a_id"), F.lit(blocks)) == k).select("pair", "docs", "best").toArrow()
        columns = [rows.column(c).to_numpy() for c in range(3)]
        order = np.argsort(columns[0])
        yield tuple(c[order] for c in columns), k + 1 == blocks


def alignment_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``; see ``alignment`` for the cases.

    The counts are looked up in blocks; a block is what is broadcast, whatever the number of pairs, and each further block reads the rows once more.
    """
    context = docs.sparkSession.sparkContext
    found = written(_aligned(docs, doc_id, text, byte_model, piece_model), "aligned")
    files = context.broadcast(load_files(byte_model, piece_model))
    counts = pair_counts(found, files)
    out = found.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for block, last in _blocks(counts):
        scan = _scored(context.broadcast(block), files, last)
        if not last:
            out = written(out.mapInArrow(scan, out.schema), "scored")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return out.mapInArrow(scan, ", ".join(f"{n} long" for n in names) + ", groups_sha256 string")
