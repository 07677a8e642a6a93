"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A batch's new words are concatenated and indexed by a suffix array; binary search gives the range of suffixes that begin with each piece, so all
occurrences of all pieces are known as edges. Sorted by position they are relaxed from left to right. BPE's encoding of every prefix ends in
exactly one piece that is compatible with the last piece of what stands before it: no merge across their border comes first when the merges are undone
in reverse order. So relaxing keeps that one edge for each position, and the result equals BPE's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare
from .words import mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose encoding a Python worker remembers, and pairs of pieces whose compatibility it remembers; both only save work.
REMEMBERED_WORDS = 400_000
REMEMBERED_PAIRS = 1 << 21
#: Largest vocabulary that is broadcast.
MOST_PIECES = 1_000_000


@dataclass
class Vocabulary:
    """Pieces by id; merge rank, parts of the last merge, and what each id decodes to."""

    texts: list[str]
    ranks: np.ndarray  # -1 for single characters
    left: np.ndarray
    right: np.ndarray
    usable: np.ndarray  # ids that encoding can give (no control, byte or unreachable pieces)
    byte_ids: np.ndarray  # id of each byte value
    unknown: int
    raw: list[bytes] = field(repr=False)
    dummy_prefix: bool = True


def _merged(text: str, ids: dict[str, int], ranks: dict[str, int]) -> tuple[str, str] | None:
    """Parts of the last merge when BPE turns ``text`` into one piece, None if it does not."""
    parts = list(text)
    last = None
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ids:
            return None
        last = parts[best], parts[best + 1]
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return last


def load_vocabulary(model: str = MODEL) -> Vocabulary:
    """Vocabulary of a BPE model file with byte fallback, read on the driver."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    n = p.get_piece_size()
    if n > MOST_PIECES:
        raise ValueError(f"{model} has {n} pieces; at most {MOST_PIECES} are supported")
    texts = [p.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    ids = {texts[i]: i for i in plain}
    order = sorted((i for i in plain if len(texts[i]) > 1), key=lambda i: -p.get_score(i))
    ranks = np.full(n, -1, dtype=np.int64)
    ranks[order] = np.arange(len(order))
    named = {texts[i]: int(ranks[i]) for i in order}
    left, right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    usable = np.zeros(n, dtype=bool)
    for i in plain:
        if len(texts[i]) == 1:
            usable[i] = True
        elif (parts := _merged(texts[i], ids, named)) and parts[0] in ids and parts[1] in ids:
            left[i], right[i], usable[i] = ids[parts[0]], ids[parts[1]], True
    byte_ids = np.full(256, p.unk_id(), dtype=np.int64)
    raw = [t.encode() for t in texts]
    for i in range(n):
        if p.is_byte(i):
            byte_ids[int(texts[i][3:5], 16)] = i
            raw[i] = bytes([int(texts[i][3:5], 16)])
        elif p.is_control(i):
            raw[i] = b""
        elif p.is_unknown(i):
            raw[i] = " ⁇ ".encode()
    dummy = bool(len(got := p.encode("a", out_type=str)) and got[0].startswith(SPACE))
    return Vocabulary(texts, ranks, left, right, usable, byte_ids, p.unk_id(), raw, dummy)


class Encoder:
    """Encodes words (maximal stretches that no piece crosses) with what ``Vocabulary`` says."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        used = np.flatnonzero(v.usable)
        self.width = 4
        while self.width < max(len(v.texts[i]) for i in used):
            self.width *= 2
        letters = sorted({c for i in used for c in v.texts[i]})
        self.letters = {c: k + 1 for k, c in enumerate(letters)}  # 0 ends a word
        self.other = len(letters) + 1  # characters that no piece has
        self.letter_of = np.full(0x110000, self.other, dtype=np.uint16)
        for c, k in self.letters.items():
            self.letter_of[ord(c)] = k
        self.cuttable = not any(SPACE in v.texts[i].lstrip(SPACE) for i in used)
        self.cutter = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if self.cuttable else re.compile(r"[\s\S]+")
        self.piece_ids = used
        self.lengths = np.array([len(v.texts[i]) for i in used])
        codes = np.zeros((len(used), self.width), dtype=np.uint16)
        for k, i in enumerate(used):
            codes[k, :len(v.texts[i])] = [self.letters[c] for c in v.texts[i]]
        self.low_keys = self._packed(codes)
        codes[codes == 0] = 0xFFFF
        self.high_keys = self._packed(codes)
        made = np.flatnonzero(v.left >= 0)
        self.loose = len(v.texts)  # stands for a character without a piece
        pair = v.left[made] * (self.loose + 1) + v.right[made]
        order = np.argsort(pair)
        self.pairs, self.pair_rank = pair[order], v.ranks[made][order]
        self.ranks = np.append(v.ranks, -1)
        self.left, self.right = np.append(v.left, -1), np.append(v.right, -1)
        self.seen_pair = np.full(REMEMBERED_PAIRS, -1, dtype=np.int64)
        self.seen_fits = np.zeros(REMEMBERED_PAIRS, dtype=bool)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.flat = [0], [np.zeros(0, dtype=np.int32)]

    @staticmethod
    def _packed(codes: np.ndarray) -> list[np.ndarray]:
        c = codes.astype(np.uint64)
        return [(c[:, k] << np.uint64(48)) | (c[:, k + 1] << np.uint64(32)) | (c[:, k + 2] << np.uint64(16)) | c[:, k + 3]
                for k in range(0, codes.shape[1], 4)]

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix array by the first ``width`` characters (rank doubling), and its packed characters in suffix order."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.width, np.uint16)]).astype(np.uint64)
        four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
        key, size = four[:n], 4
        while True:
            order = np.argsort(key)
            if size >= self.width:
                break
            ranked = np.zeros(n + size, dtype=np.uint64)
            by = key[order]
            ranked[order] = np.cumsum(np.append(True, by[1:] != by[:-1])).astype(np.uint64)
            key = (ranked[:n] << np.uint64(32)) | ranked[size:size + n]
            size *= 2
        full = np.concatenate([four, np.zeros(self.width, np.uint64)])
        return order, [full[order + k] for k in range(0, self.width, 4)]

    @staticmethod
    def _bounds(suffixes: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all wanted keys at once: first suffix not below (or, ``after``, above) each."""
        low = np.zeros(len(wanted[0]), dtype=np.int64)
        high = np.full(len(wanted[0]), len(suffixes[0]), dtype=np.int64)
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(suffixes[0]) - 1)
            less, equal = np.zeros(len(low), dtype=bool), np.ones(len(low), dtype=bool)
            for s, w in zip(suffixes, wanted):
                own = s[mid]
                less |= equal & (own < w)
                equal &= own == w
            down = less | equal if after else less
            open_ = low < high
            low, high = np.where(open_ & down, mid + 1, low), np.where(open_ & ~down, mid, high)
        return low

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE keeps a border between two neighbouring pieces: undo the later merge until a merge across the border shows."""
        good = np.ones(len(first), dtype=bool)
        live = np.arange(len(first))
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), np.int64(1) << 60)
        while len(live):
            pair = a * (self.loose + 1) + b
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            crossed = (self.pairs[at] == pair) & (self.pair_rank[at] < limit)
            good[live[crossed]] = False
            ra, rb = self.ranks[a], self.ranks[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            late = ra > rb
            limit = np.where(late, ra, rb + 1)  # equal merges go from left to right
            a, b = np.where(late, self.right[a], a), np.where(late, b, self.left[b])
        return good

    def _fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first * (self.loose + 1) + second
        slot = (mixed(key.astype(np.uint64)) & np.uint64(REMEMBERED_PAIRS - 1)).astype(np.int64)
        out = self.seen_fits[slot]
        missing = np.flatnonzero(self.seen_pair[slot] != key)
        if len(missing):
            keys, back = np.unique(key[missing], return_inverse=True)
            fresh = self._compatible(keys // (self.loose + 1), keys % (self.loose + 1))
            out[missing] = fresh[back]
            at = (mixed(keys.astype(np.uint64)) & np.uint64(REMEMBERED_PAIRS - 1)).astype(np.int64)
            kept = np.unique(at, return_index=True)[1]  # one key for each slot
            self.seen_pair[at[kept]], self.seen_fits[at[kept]] = keys[kept], fresh[kept]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.letter_of[points]
        ends = np.cumsum(sizes + 1) - 1
        begin = ends - sizes
        codes = np.append(codes, np.uint16(0))
        codes[ends] = 0
        order, suffixes = self._suffixes(codes)
        low, high = self._bounds(suffixes, self.low_keys, False), self._bounds(suffixes, self.high_keys, True)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        start = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        piece, stop = self.piece_ids[which], start + self.lengths[which]
        inside = np.ones(len(codes), dtype=bool)
        inside[ends] = False
        loose = np.flatnonzero(inside & (codes == self.other))
        start, stop = np.concatenate([start, loose]), np.concatenate([stop, loose + 1])
        piece = np.concatenate([piece, np.full(len(loose), self.loose)])
        # edges by the place of their end within their word, so that one step relaxes that place of all words
        owner_begin = np.repeat(begin, sizes + 1)
        step = stop - owner_begin[start]
        by = np.argsort(step, kind="stable")
        start, stop, piece = start[by], stop[by], piece[by]
        at_begin = start == owner_begin[start]
        bounds = np.searchsorted(step[by], np.arange(1, int(sizes.max(initial=0)) + 2))
        last = np.full(len(codes) + 1, -1, dtype=np.int64)
        origin = np.full(len(codes) + 1, -1, dtype=np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            s, p = start[a:b], piece[a:b]
            before = last[s]
            good = at_begin[a:b].copy()
            inner = np.flatnonzero(~good & (before >= 0))
            if len(inner):
                good[inner] = self._fits(before[inner], p[inner])
            e = stop[a:b][good]
            last[e], origin[e] = p[good], s[good]
        # walk back from every word's end at once
        at, owner = ends[sizes > 0], np.flatnonzero(sizes > 0)
        tokens, owners, places = [], [], []
        while len(at):
            tokens.append(last[at])
            owners.append(owner)
            places.append(origin[at])
            at = origin[at]
            going = at > begin[owner]
            at, owner = at[going], owner[going]
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        tokens, owners, places = np.concatenate(tokens), np.concatenate(owners), np.concatenate(places)
        by = np.argsort(places, kind="stable")  # places rise from word to word
        tokens, owners, places = tokens[by], owners[by], places[by]
        if (tokens == self.loose).any():
            tokens, owners = self._with_bytes(tokens, owners, places, points)
        return tokens.astype(np.int32), np.bincount(owners, minlength=len(words))

    def _with_bytes(self, tokens: np.ndarray, owners: np.ndarray, places: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their UTF-8 bytes."""
        spelled = {p: self.v.byte_ids[list(chr(p).encode("utf-8", "replace"))] for p in np.unique(points[places[tokens == self.loose]]).tolist()}
        size = np.ones(len(tokens), dtype=np.int64)
        odd = np.flatnonzero(tokens == self.loose)
        parts = [spelled[p] for p in points[places[odd]].tolist()]
        size[odd] = [len(x) for x in parts]
        out = np.repeat(tokens, size)
        begin = np.cumsum(size) - size
        for k, x in zip(odd.tolist(), parts):
            out[begin[k]:begin[k] + len(x)] = x
        return out, np.repeat(owners, size)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if len(self.number) > REMEMBERED_WORDS:
            self.forget()
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        prefix = SPACE if self.v.dummy_prefix else ""
        for r, t in enumerate(texts):
            if t:
                own = self.cutter.findall(prefix + t.replace(" ", SPACE))
                counts[r] = len(own)
                words += own
        new = list(set(words) - self.number.keys())
        if new:
            flat, sizes = self.encode_words(new)
            base, shift = len(self.number), self.begin[-1]
            self.number.update(zip(new, range(base, base + len(new))))
            self.begin += (shift + np.cumsum(sizes)).tolist()
            self.flat.append(flat)
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        begin = np.array(self.begin, dtype=np.int64)
        index = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        size = begin[index + 1] - begin[index]
        where = np.repeat(begin[index] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ids = self.flat[0][where]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        return ids, np.diff(np.concatenate([[0], ends]))


def decoded(ids: list[int] | np.ndarray, vocabulary: Vocabulary) -> str:
    """Text of ids: byte pieces are joined to UTF-8, the marks become spaces again, the added first space goes."""
    text = b"".join(map(vocabulary.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if vocabulary.dummy_prefix and text.startswith(" ") else text


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """One encoder for each Python worker and vocabulary, so remembered words last over tasks."""
    if vocabulary.value is not None and id(vocabulary.value) not in _encoders:
        _encoders.clear()
        _encoders[id(vocabulary.value)] = Encoder(vocabulary.value)
    return _encoders[id(vocabulary.value)]


def encoded(docs: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with two more columns: the piece ids of each whole text and their number.

    Null and empty texts have no ids. A text column is needed; all other columns pass unchanged whatever their names, but for columns named
    ``ids`` or ``n_tokens``, which are replaced. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(model))
    rest = [c for c in docs.columns if c not in (ids, n_tokens)]
    rows = docs.select(*(F.col(f"`{c}`") for c in rest))
    place = rest.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            flat, sizes = encoder.encode(batch.column(place).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sizes, pa.int64())], names=[*rest, ids, n_tokens])

    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n_tokens, T.LongType())]
    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields, *more]))


def with_decoded(rows: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text that the ids stand for; null ids give a null text, no ids the empty text."""
    spark = rows.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(model))
    rest = [c for c in rows.columns if c != text]
    chosen = rows.select(*(F.col(f"`{c}`") for c in rest))
    place = rest.index(ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            lists = batch.column(place)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            begins = np.concatenate([[0], ends[:-1]])
            texts = [None if not ok else decoded(flat[a:b].tolist(), v) for a, b, ok in zip(begins, ends, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*rest, text])

    return chosen.mapInArrow(scan, T.StructType([*chosen.schema.fields, T.StructField(text, T.StringType())]))
