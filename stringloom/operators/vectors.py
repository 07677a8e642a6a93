"""TF-IDF vectors of strings, with copies collapsed to one vector each."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import smoothed_idf, word_counts, words
from ..plans.ranking import with_position
from ..plans.scratch import dropped, scratch_path, written
from ..plans.skew import salted_join
from ..plans.spread import spread

#: Terms of most rows that every task holds. It bounds a broadcast (about 25 MB) and does not grow with the data; all other terms are joined.
COMMON = 1 << 18


class TermVectors(NamedTuple):
    members: DataFrame   # id, vec, copies: the vector of each row and how many rows share it
    vectors: DataFrame   # vec, copies, terms (ranks, rarest first), weights (unit length)
    terms: DataFrame     # term, df, idf, rank (0 = rarest)
    rows: int
    entries: int         # stored (vector, term) pairs
    row_entries: int     # (row, term) pairs, copies included
    vocabulary: int
    shared_ids: bool = False  # an id stands on several strings


class NoWords(ValueError):
    """No string holds a word, so there is no vocabulary."""


def rejected_strings(strings: DataFrame) -> DataFrame:
    """Rows that cannot be vectorised, with the reason."""
    return strings.where(F.col("string").isNull()).select("id", F.lit("null string").alias("reason"))


def term_vectors(strings: DataFrame) -> TermVectors:
    """Vectorise (id, string): count words, weigh by smoothed idf, scale to unit length.

    Strings with the same word counts have the same vector, so they are collapsed first (``vec`` is the
    smallest of their ids) and a group of copies of any size costs one vector.
    """
    # a row's sorted words give its key; its distinct words are counted where the row is read, so no pair of row and word is shuffled for that
    present = spread(strings.where(F.col("string").isNotNull()))
    ordered = present.select("id", F.sort_array(words(F.col("string"))).alias("w"))
    keyed = ordered.select("id", F.unhex(F.sha2(F.array_join("w", " "), 256)).alias("key"), word_counts("w").alias("e"))
    numbered = keyed.select(F.monotonically_increasing_id().alias("row"), "id", "key", F.col("e.terms").alias("terms"), F.col("e.counts").alias("counts"))
    keyed = written(numbered, "keys")
    # rows of one key have the same counts, so one row stands for the key: the first with the smallest id
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row")))
    found = keyed.groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = written(found.select("key", F.col("first.row").alias("row"), F.col("first.id").alias("vec"), "copies"), "groups")
    rows = keyed.count()
    members = written(salted_join(keyed.select("id", "key"), groups.select("key", "vec", "copies"), "key", "copies", rows, "id"), "members")

    firsts = groups.where(F.col("vec").isNotNull()).select("row", "vec", "copies")
    keys, held, names = groups.agg(F.count(F.lit(1)), F.count("vec"), F.countDistinct("vec")).first()
    source, times = keyed.select("row", "terms", "counts"), F.lit(1)
    if held < keys:
        source = keyed.join(groups.where(F.col("vec").isNotNull()).select("key"), "key", "left_semi").select("row", "terms", "counts")
    if held > names:
        source, firsts, times = _merged(source.join(firsts, "row")), None, F.col("copies")
    row_entries = source.agg(F.coalesce(F.sum(times * F.size("terms")), F.lit(0))).first()[0]
    if row_entries == 0:
        raise NoWords("no string holds a word of two or more characters")
    sizes = source.select(times.cast("long").alias("n"), F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    terms = with_position(sizes, ["df", "term"], "rank").withColumn("idf", smoothed_idf(F.lit(float(rows)), F.col("df")))
    vocabulary = terms.count()
    vectors = written(_packed(source, terms, vocabulary, row_entries, firsts), "vectors")
    dropped(keyed)  # the rows' words, which only the members and vectors were made from
    entries = vectors.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    return TermVectors(members.select("id", "vec", "copies"), vectors, terms, rows, entries, row_entries, vocabulary, held > names)


def _merged(firsts: DataFrame) -> DataFrame:
    """(vec, copies, terms, counts) of ``firsts`` where an id stands on several strings: their words count together."""
    long = firsts.select("vec", "copies", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
    summed = long.groupBy("vec", "copies", F.col("e.terms").alias("term")).agg(F.sum("e.counts").cast("int").alias("n"))
    lists = summed.groupBy("vec", "copies").agg(F.collect_list(F.struct("term", "n")).alias("e"))
    pair = lists.select("vec", "copies", F.transform("e", lambda e: e["term"]).alias("terms"), F.transform("e", lambda e: e["n"]).alias("counts"))
    blank = firsts.where(F.size("terms") == 0).select("vec", "copies", "terms", "counts")
    return written(pair.unionByName(blank.join(pair.select("vec", "copies"), ["vec", "copies"], "left_anti")), "merged")


def _packed(source: DataFrame, terms: DataFrame, vocabulary: int, row_entries: int, firsts: DataFrame | None = None) -> DataFrame:
    """(vec, copies, terms, weights) of (vec, copies, terms, counts), or of the rows of (row, terms, counts) that ``firsts`` (row, vec, copies) names.

    The COMMON terms of most rows become ranks where a row is read. Only entries of rarer terms are shuffled with their text, to their term and back;
    the ranks and counts of a row meet ``firsts`` and them in one more shuffle, and weights are made after it.
    """
    keys = ["vec", "copies"] if firsts is None else ["row"]
    named = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in keys)
    edge = vocabulary - COMMON
    common = terms.where(F.col("rank") >= edge).select("term", "rank").toArrow()
    names = common.column("term").combine_chunks()
    # terms stand in order of their df, so its steps give the idf of every rank; n steps need n * (n + 1) / 2 entries
    steps = terms.groupBy("df", "idf").agg(F.min("rank").alias("rank")).orderBy("rank").toArrow()
    context = source.sparkSession.sparkContext
    shared = context.broadcast((names, (common.column("rank").to_numpy() - edge).astype(np.int32)))
    stairs = context.broadcast((steps.column("rank").to_numpy(), steps.column("idf").to_numpy()))

    def scan(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        names, ranks = shared.value
        for batch in batches:
            flat, counts = batch.column("terms").flatten(), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            at = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False)
            if rest:
                rare = pa.array(np.flatnonzero(at < 0))
                row = pa.array(owner).take(rare)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keys), flat.take(rare), pa.array(counts, pa.int32()).take(rare)],
                                                 names=[*keys, "term", "tf"])
                continue
            known = at >= 0
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[known], minlength=batch.num_rows)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keys), pa.ListArray.from_arrays(ends, pa.array(ranks[at[known]], pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts[known], pa.int32()))], names=[*keys, "places", "counts"])

    found = source.mapInArrow(lambda b: scan(b, False), f"{named}, places array<int>, counts array<int>")
    if firsts is not None:
        found = found.join(firsts, "row")
    if edge > 0:
        rest = source.mapInArrow(lambda b: scan(b, True), f"{named}, term string, tf int")
        placed = salted_join(rest, terms.where(F.col("rank") < edge).select("term", "rank", "df"), "term", "df", row_entries, keys[0])
        # a row's terms are bounded by its own text
        found = found.join(placed.groupBy(*keys).agg(F.collect_list(F.struct("rank", "tf")).alias("rare")), keys, "left")
    else:
        found = found.withColumn("rare", F.lit(None).cast("array<struct<rank:bigint,tf:int>>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, idf = stairs.value
        for batch in batches:
            n, more = batch.num_rows, batch.column("rare").flatten()
            owner = [np.repeat(np.arange(n), pc.fill_null(batch.column(c).value_lengths(), 0).to_numpy(zero_copy_only=False)) for c in ("places", "rare")]
            rank = np.concatenate([batch.column("places").flatten().to_numpy(zero_copy_only=False) + np.int64(edge), more.field(0).to_numpy(zero_copy_only=False)])
            tf = np.concatenate([batch.column("counts").flatten().to_numpy(zero_copy_only=False), more.field(1).to_numpy(zero_copy_only=False)])
            row = np.concatenate(owner)
            by = np.lexsort((rank, row))
            rank, row = rank[by], row[by]
            x = tf[by] * idf[np.searchsorted(begin, rank, side="right") - 1]
            norm = np.sqrt(np.bincount(row, weights=x * x, minlength=n))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), batch.column("copies"), pa.ListArray.from_arrays(ends, pa.array(rank, pa.int64())),
                 pa.ListArray.from_arrays(ends, pa.array(x / norm[row], pa.float64()))], names=["vec", "copies", "terms", "weights"])

    kind = found.schema["vec"].dataType.simpleString()
    return found.select("vec", "copies", "places", "counts", "rare").mapInArrow(pack, f"vec {kind}, copies long, terms array<long>, weights array<double>")


def long_weights(vectors: DataFrame) -> DataFrame:
    """(vec, copies, term, weight): one row per stored entry."""
    return vectors.select("vec", "copies", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(
        "vec", "copies", F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))


def ml_features(vectors: DataFrame, vocabulary: int, width: int | None = None) -> DataFrame:
    """(vec, copies, features) with sparse ML vectors; ``width`` folds the vocabulary into that many columns.

    The stored layout of an ML vector is a plain struct, so a table written as the struct is read back as vectors
    and no row passes through Python.
    """
    indices, values, size = F.col("terms").cast("array<int>"), F.col("weights"), vocabulary
    if width is not None and width < vocabulary:
        size = width
        folded = long_weights(vectors).groupBy("vec", "copies", F.pmod("term", F.lit(width)).cast("int").alias("at")).agg(
            F.sum("weight").alias("x")).groupBy("vec", "copies").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("e"))
        blank = vectors.where(F.size("terms") == 0).select("vec", "copies", F.array().cast("array<struct<at:int,x:double>>").alias("e"))
        vectors = folded.unionByName(blank)
        indices, values = F.transform("e", lambda e: e["at"]), F.transform("e", lambda e: e["x"])
    spark = vectors.sparkSession
    path = scratch_path(spark, "features")
    layout = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    vectors.select("vec", "copies", layout.alias("features")).write.parquet(path)
    schema = T.StructType([T.StructField("vec", T.LongType()), T.StructField("copies", T.LongType()),
                           T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def row_weights(tv: TermVectors) -> DataFrame:
    """(id, term, weight) for every row, copies included."""
    # a vector serves one row of its own id as it is read; only rows beyond that, and vectors that have such rows, are shuffled
    own = F.col("id").eqNullSafe(F.col("vec"))
    again = tv.members.where(own).groupBy("vec").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    beyond = tv.members.where(~own).select("id", "vec").unionByName(
        again.select(F.col("vec").alias("id"), "vec", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("id", "vec"))
    several = tv.vectors if tv.shared_ids else tv.vectors.where(F.col("copies") > 1)
    per_row = tv.vectors.select(F.col("vec").alias("id"), "terms", "weights").unionByName(
        salted_join(beyond, several, "vec", "copies", tv.rows, "id").select("id", "terms", "weights"))
    long = per_row.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(
        "id", F.col("e.terms").alias("rank"), F.col("e.weights").alias("weight"))
    edge = tv.vocabulary - COMMON
    common = tv.terms.where(F.col("rank") >= edge).select("rank", "term")
    named = long.where(F.col("rank") >= edge).join(F.broadcast(common), "rank")
    if edge > 0:
        rare = tv.terms.where(F.col("rank") < edge).select("rank", "term", "df")
        named = named.select("id", "term", "weight").unionByName(
            salted_join(long.where(F.col("rank") < edge), rare, "rank", "df", tv.row_entries, "id").select("id", "term", "weight"))
    return named.select("id", "term", "weight")


def spread_to_rows(tv: TermVectors, per_vector: DataFrame) -> DataFrame:
    """Give every row the columns of its vector; ``per_vector`` has ``vec`` and ``copies``."""
    return salted_join(tv.members.drop("copies"), per_vector, "vec", "copies", tv.rows, "id")
