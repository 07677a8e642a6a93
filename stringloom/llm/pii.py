"""Personal data in texts: four base patterns, then identifiers that only their wording gives away.

Seeds are the base matches. The word before a seed, with the marks that follow it, is a lexical pattern; tokens of identifier shape after the same are further
instances. Scores run
over the pattern-instance graph in rounds: a pattern scores the mean of its instances, an unknown instance the mean of its patterns.
A pattern that scores high, has several different seeds and is mostly followed by identifiers marks the other tokens after it.
Everything here is DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fresh_names, written

KINDS = ("email", "ip", "card", "phone")

# The base patterns of the contract, written so that they scan in linear time: a match can only begin where a run of its characters begins or where
# the last match ended (\G), and runs give nothing back.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with single separators, of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "phone": "+"}

#: Identifier-shaped tokens that are not base matches. Of any kind: 6 to 64 characters with at least five digits; a key glued by a colon is its cue.
_START = r"(?<![A-Za-z0-9._@+/()-])(?!:)(?![A-Za-z_]{1,40}:[0-9+(])"
_ANY = r"(?=[A-Za-z._@+/:()-]{0,63}[0-9])[A-Za-z0-9._@+/:()-]{6,}+"
_WHOLE_NUMBER = r"(?=(?:[A-Za-z._@+/:()-]{0,63}+[0-9]){10})[A-Za-z0-9._@+/:()-]{6,}+"
#: Of one kind: mail addresses without digits, without a domain or with the signs written out; addresses of hexadecimal groups; digit groups with spaces.
_AT, _DOT = r"(?:@| ?[(\[{] ?(?i:at) ?[)\]}] ?)", r"(?:\.| ?[(\[{] ?(?i:dot) ?[)\]}] ?)"
_SHAPES = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]{{1,64}}+{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)*+",
    "ip": r"(?<![\p{L}\p{N}:.])(?=:{0,2}[0-9A-Fa-f])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![\p{L}\p{N}:_@]|[./-][\p{L}\p{N}])",
    "digits": r"(?<![\p{L}\p{N}._@+/-])\+?\(?[0-9]{1,19}+(?:(?:[ ./-]|\)[ /-]?| ?\()[0-9]{1,19}+){1,9}(?![\p{L}\p{N}_@]|[./:-][\p{L}\p{N}])",
}
#: One alternative for each shape, so tokens never overlap; an unspaced number of ten digits is whole and takes no further groups.
_TOKEN = "|".join((_SHAPES["ip"], _SHAPES["email"], _START + _WHOLE_NUMBER, _SHAPES["digits"], _START + _ANY))
_MAYBE = r"[0-9@]|[0-9A-Fa-f:]:[0-9A-Fa-f:]|[(\[{] ?(?i:at) ?[)\]}]"
#: Units that cues are cut from: a word (its last 40 characters) with the marks after it.
_WORD, _MARK = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_\s]"
_UNIT = rf"{_WORD}++{_MARK}*+|{_MARK}++"
_LONG = 40
#: Rounds of scoring, the score and the number of different seeds a pattern needs, and how often an identifier must follow its word.
ROUNDS = 3
PATTERN_SCORE = 0.6
SEEDS = 5
FOLLOWED = 0.3

_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
#: Pieces whose lengths are added up at once; positions of the places in a text are sums of block sums and of sums within a block.
BLOCK = 128
#: Code points of a piece that a text is cut into to reach its places.
CHUNK = 1_024
#: Characters that no text has a use for: around a match, and in place of those that a text holds all the same.
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufdd2"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, upto: Column, start: Column, add) -> Column:
    """``add`` over the first ``upto`` values, beginning with ``start``."""
    return F.aggregate(F.slice(values, F.lit(1), upto), start, add)


def _block_starts(values: Column, start: Column, add) -> Column:
    """``add`` over all values before each block of BLOCK values."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    return _let(F.transform(blocks, lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), start, add)),
                lambda sums: F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: _running(sums, b, start, add)))


def _before(values: Column, starts: Column, i: Column, add) -> Column:
    """``add`` over the first ``i`` values, from the start of their block on."""
    block = F.floor(i / BLOCK).cast("int")
    return F.aggregate(F.slice(values, block * BLOCK + 1, i - block * BLOCK), F.get(starts, block), add)


def _found(text: Column, pattern: str) -> Column:
    """Matches with their code-point ranges, in time that grows with the text: one pass of the pattern sets marks around them, the pieces' lengths give places."""
    plain = F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)
    pieces = F.split(F.regexp_replace(plain, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), f"[{_OPEN}{_CLOSE}]", -1)
    plus = lambda a, x: a + x

    def spans(p: Column) -> Column:
        return _let(F.transform(p, lambda x: F.length(x).cast("bigint")), lambda sizes: _let(
            _block_starts(sizes, F.lit(0).cast("bigint"), plus), lambda starts: F.transform(
                F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: _let(_before(sizes, starts, i, plus), lambda at: F.struct(
                    at.alias("start"), (at + F.get(sizes, i)).alias("end"), F.get(p, i).alias("value"))))))

    return _let(pieces, lambda p: F.when(F.size(p) > 2, spans(p)).otherwise(F.array().cast(_SPAN)))


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _outside(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span (by start). The last base span that starts before a token's end is found by halving; what ends latest up to it decides."""
    def kept(ends: Column, starts: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(base).cast("double"))).cast("int") + 1)

        def before(t: Column) -> Column:
            """How many base spans start before the token's end."""
            middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
            open_ = lambda s: s["low"] < s["high"]
            less = lambda s: F.get(base, middle(s))["start"] < t["end"]
            return F.aggregate(
                steps, F.struct(F.lit(0).alias("low"), F.size(base).alias("high")),
                lambda s, _: F.struct(F.when(open_(s) & less(s), middle(s) + 1).otherwise(s["low"]).alias("low"),
                                      F.when(open_(s) & ~less(s), middle(s)).otherwise(s["high"]).alias("high")),
                lambda s: s["low"])
        return F.filter(tokens, lambda t: _before(ends, starts, before(t), _later) <= t["start"])

    least = F.lit(-1).cast("bigint")
    apart = _let(F.transform(base, lambda b: b["end"]), lambda ends: _let(_block_starts(ends, least, _later), lambda starts: kept(ends, starts)))
    return F.when(F.size(base) > 0, apart).otherwise(tokens)


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(F.reverse(digits), i, F.lit(1)).cast("int")).otherwise(
            F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * 2
            - F.when(F.substring(F.reverse(digits), i, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _base(text: Column) -> Column:
    """Valid base matches of all kinds, by start and then by kind as listed."""
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string,value:string>>")

    def of_kind(place: int, kind: str) -> Column:
        valid = F.filter(_found(text, _PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        spans = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"),
                                                      F.lit(kind).alias("kind"), s["value"].alias("value")))
        hint = F.instr(text, _HINTS[kind]) > 0 if kind in _HINTS else text.rlike("[0-9]")
        return F.when(hint, spans).otherwise(none)

    return F.array_sort(F.concat(*(of_kind(place, kind) for place, kind in enumerate(KINDS))))


def _chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points: a place is reached without counting from the start of the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _part(chunks: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` up to ``end``."""
    first, last = F.floor(begin / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    offset = (begin - first * CHUNK + 1).cast("int")
    inner = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first >= last, F.substring(chunk(first), offset, F.greatest(end - begin, F.lit(0)).cast("int"))).otherwise(
        F.concat(F.substring(chunk(first), offset, F.lit(CHUNK)), inner, F.substring(chunk(last), F.lit(1), (end - last * CHUNK).cast("int"))))


def _cue(chunks: Column, start: Column) -> Column:
    """The word before a place with the marks after it, in lower case, and a blank where blanks follow; empty at the start of a line or text."""
    before = _part(chunks, F.greatest(start - 128, F.lit(0)), start)
    unit = F.regexp_extract(before, rf"({_WORD}{{0,{_LONG}}}+{_MARK}{{0,{_LONG}}}+)[ \t]{{0,48}}+$", 1)
    return F.when(unit == "", "").otherwise(F.lower(F.concat(unit, F.when(before.rlike(r"[ \t]$"), " ").otherwise(""))))


def _cues(unit: Column) -> Column:
    """Every cue that an identifier after or within a unit can have: the unit before blanks, and up to each of its marks."""
    word = F.regexp_extract(unit, rf"^{_WORD}*+", 0)
    marks = F.substring(unit, F.length(word) + 1, F.lit(_LONG))
    word = F.substring(word, F.greatest(F.length(word) - _LONG, F.lit(0)) + 1, F.lit(_LONG))
    glued = F.transform(F.sequence(F.lit(0), F.length(marks)), lambda n: F.concat(word, F.substring(marks, F.lit(1), n)))
    return F.concat(F.array(F.concat(word, marks, F.lit(" "))), glued)


def _suits(value: Column) -> Column:
    """Kinds that a token may be of by its shape."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    whole = lambda shape: value.rlike(f"^(?:{_SHAPES[shape]})$")
    any_kind = (digits >= 5) & value.rlike("^[A-Za-z0-9._@+/:()-]{6,}$")
    number = whole("digits") & digits.between(6, 19)
    fits = {"email": whole("email"), "ip": whole("ip"), "card": number, "phone": number}
    kinds = F.array(*(F.when(any_kind | fits[k], F.lit(k)) for k in KINDS))
    return F.when(F.length(value) <= 64, F.filter(kinds, lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))


def _instances(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, tokens): base spans and identifier-shaped tokens outside them, both with the word before them."""
    text = F.col("text")
    found = rows.withColumn("base", _base(text))
    tokens = F.filter(_found(text, _TOKEN), lambda t: F.size(_suits(t["value"])) > 0)
    tokens = F.when(text.rlike(_MAYBE), _let(tokens, lambda t: _let(F.col("base"), lambda b: _outside(t, b)))).otherwise(F.array().cast(_SPAN))
    with_cue = _let(_chunks(text), lambda ch: F.transform(tokens, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), _cue(ch, t["start"]).alias("cue"))))
    base = _let(_chunks(text), lambda ch: F.transform("base", lambda b: F.struct(
        b["start"].alias("start"), b["place"].alias("place"), b["end"].alias("end"), b["kind"].alias("kind"), b["value"].alias("value"),
        _cue(ch, b["start"]).alias("cue"))))
    return found.withColumn("tokens", with_cue).withColumn("base", base).drop("text")


def _patterns(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(cue, kinds) of the trusted patterns, scored over the whole graph; kinds of more seeds first."""
    seeds = found.select(F.explode("base").alias("s")).select("s.cue", "s.value", "s.kind", F.lit(1.0).alias("known"))
    others = found.select(F.explode("tokens").alias("s")).select("s.cue", "s.value", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("known"))
    edges = (seeds.unionByName(others).where("cue <> ''").groupBy("cue", "value")
             .agg(F.max("known").alias("known"), F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")))
    edges = written(edges, "edges")
    support = edges.groupBy("cue").agg(F.sum(F.when(F.col("known") == 1, 1).otherwise(0)).alias("seeds"), F.sum("n").alias("followed"))
    scored = edges.withColumn("score", F.coalesce("known", F.lit(0.0)))
    for _ in range(ROUNDS):
        # one added empty instance keeps patterns with a single seed low
        patterns = scored.groupBy("cue").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust"))
        instances = scored.join(patterns, "cue").groupBy("value").agg(F.avg("trust").alias("mean"))
        scored = (edges.join(instances, "value").withColumn("score", F.coalesce("known", "mean")).drop("mean"))
        scored = written(scored, "scored")
    trust = scored.groupBy("cue").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust"))
    strong = support.where(F.col("seeds") >= SEEDS).join(trust.where(F.col("trust") >= PATTERN_SCORE), "cue")
    # counted in the unit that cues are cut from; a cue that is not counted has at least the places where it was seen
    units = rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_UNIT), F.lit(0))).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    every = units.select(F.explode(_cues(F.col("unit"))).alias("cue"), "n").groupBy("cue").agg(F.sum("n").alias("all"))
    specific = strong.join(every, "cue", "left").where(F.col("followed") >= FOLLOWED * F.coalesce("all", "followed"))
    kinds = edges.where("known = 1").groupBy("cue", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = kinds.groupBy("cue").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "kind"))))["kind"].alias("kinds"))
    return specific.select("cue").join(best, "cue")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, extra) for every row: arrays of (start, place, end, kind), in code points, end exclusive.

    ``base`` holds the valid matches of the four patterns, ``extra`` what trusted patterns add outside of them. Null and empty texts have none.
    Repeated rows give repeated results; a row without an id is handled like any other. Other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    found = written(_instances(rows), "spans")
    trusted = written(_patterns(found, rows), "patterns")
    marked = (found.where("size(tokens) > 0").select("doc_id", "text_hash", F.explode("tokens").alias("t"))
              .select("doc_id", "text_hash", "t.*").join(trusted, "cue"))
    marked = (marked.withColumn("suits", _suits(F.col("value"))).withColumn("kind", F.get(F.filter("kinds", lambda k: F.array_contains("suits", k)), F.lit(0)))
              .where("kind IS NOT NULL"))
    place = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    extra = (marked.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
             .agg(F.collect_set(F.struct("start", place.alias("place"), "end", "kind")).alias("extra")))
    joined = found.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return joined.select("doc_id", "text_hash", plain.alias("base"), F.coalesce("extra", none).alias("extra"))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts, base digest and all spans as text for every row of ``docs``."""
    got = personal_data(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return got.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                      _listed(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets and ``n_chars`` (where there is one) counted anew; overlapping spans become one.

    Null and empty texts stay; very long ones are cut in time that grows with them. Repeated rows and rows without an id are handled like any other, an empty
    table gives no rows, and all other columns pass unchanged whatever their names.
    """
    got = personal_data(docs, doc_id, text)
    span_id, span_hash, spans_name = fresh_names(docs, "span_id", "span_hash", "spans")
    spans = (got.select(F.col("doc_id").alias(span_id), F.col("text_hash").alias(span_hash), F.array_sort(F.concat("base", "extra")).alias(spans_name))
             .where(F.size(spans_name) > 0).dropDuplicates([span_id, span_hash]))
    own, whole = F.col(f"`{text}`"), F.col(f"`{text}`").cast("string")
    source = F.coalesce(whole, F.lit(""))
    both = docs.join(spans, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(span_id)) & (F.xxhash64(source) == F.col(span_hash)), "left")
    both = both.withColumn(text, F.when(F.col(spans_name).isNotNull(), _cut(whole, F.col(spans_name))).otherwise(own))
    if n_chars in docs.columns:
        kind = dict(docs.dtypes)[n_chars]
        both = both.withColumn(n_chars, F.when(F.col(spans_name).isNotNull(), F.length(own).cast(kind)).otherwise(F.col(f"`{n_chars}`")))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns))


def _cut(text: Column, spans: Column) -> Column:
    """The text with its sorted spans replaced. Each span's part is made on its own: a span that starts inside an earlier one has none, and the text behind a span
    reaches from the latest end so far to the next span's start."""
    def parts(s: Column, ends: Column, starts: Column, chunks: Column) -> Column:
        reach = lambda i: _before(ends, starts, i, _later)
        between = lambda a, b: _part(chunks, a, b)

        def part(i: Column) -> Column:
            return _let(reach(i), lambda done: F.when(F.get(s, i)["start"] >= done, F.concat(
                between(done, F.get(s, i)["start"]), F.lit("<"), F.upper(F.get(s, i)["kind"]), F.lit(">"))).otherwise(""))
        made = F.array_join(F.transform(F.sequence(F.lit(0), F.size(s) - 1), part), "")
        return F.concat(made, between(reach(F.size(s)), F.length(text).cast("bigint")))

    zero = F.lit(0).cast("bigint")
    return _let(spans, lambda s: _let(F.transform(s, lambda x: x["end"]), lambda ends: _let(
        _block_starts(ends, zero, _later), lambda starts: _let(_chunks(text), lambda ch: parts(s, ends, starts, ch)))))
