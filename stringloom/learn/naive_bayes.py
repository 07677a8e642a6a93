"""Multinomial word model kept as tables: training is counting, scoring is a join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_counts, words
from ..plans.ranking import with_position
from ..plans.scratch import written
from ..plans.skew import lookup_join
from ..plans.spread import spread

#: Classes that one row meets at once. It bounds the arrays of a task, not the number of classes.
BLOCK = 1_000
#: Frequent terms, and their class entries, that every scoring task holds (about 25 MB); all other terms are joined. Neither grows with the data.
COMMON = 1 << 18
ENTRIES = 1 << 20
#: Rows whose words a scoring task weighs at once.
ROWS = 200


@dataclass(frozen=True)
class WordModel:
    terms: DataFrame      # term, entries array<struct<at, x>>: log(count + 1) for classes that saw the term
    classes: DataFrame    # at (place in label order), label, prior (log share of rows), base (log of words + vocabulary)

    def save(self, path: str) -> None:
        self.terms.write.parquet(f"{path}/terms")
        self.classes.write.parquet(f"{path}/classes")


def load_word_model(spark: SparkSession, path: str) -> WordModel:
    return WordModel(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/classes"))


def fit_word_model(rows: DataFrame, label: str, text: str = "string") -> WordModel:
    """Add-one smoothed counts of (label, term); rows without a label are left out. Any number of classes: they are rows of a table."""
    known = spread(rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text")))
    sizes = with_position(known.groupBy("label").agg(F.count(F.lit(1)).alias("n")), ["label"], "at")
    counts = written(known.select("label", F.explode(words(F.col("text"))).alias("term")).groupBy("label", "term").agg(F.count(F.lit(1)).alias("c")), "class_counts")
    vocabulary = counts.select("term").distinct().count()
    spoken = counts.groupBy("label").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("pairs"))
    sized = written(sizes.join(spoken, "label", "left"), "class_sizes")
    total, pairs = sized.agg(F.sum("n"), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    classes = written(sized.select("at", "label", F.log(F.col("n") / F.lit(total or 1)).alias("prior"),
                                   F.log(F.coalesce("c", F.lit(0)) + F.lit(float(vocabulary))).alias("base")), "classes")
    placed = lookup_join(counts, classes.select("label", "at"), "label", pairs, "term", "inner")
    entry = F.struct(F.col("at").cast("int").alias("at"), F.log(F.col("c") + 1.0).alias("x"))
    terms = placed.groupBy("term").agg(F.collect_list(entry).alias("entries"))  # at most one entry per class
    return WordModel(written(terms, "word_model"), classes)


def _summed_up(parts: Column, top: int | None) -> Column:
    """Probabilities from a row's blocks (block, high, total, kept): all classes in label order, or the ``top`` most probable ones."""
    high = F.array_max(F.transform(parts, lambda p: p["high"]))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["total"] * F.exp(p["high"] - high))
    kept = F.flatten(F.transform(F.array_sort(parts), lambda p: p["kept"]))
    if top is not None:
        kept = F.slice(F.array_sort(kept), 1, top)
    return F.transform(kept, lambda s: F.struct(s["label"].alias("label"), (F.exp(-s["down"] - high) / total).alias("prob")))


def _common_terms(model: WordModel) -> DataFrame:
    """The terms said most often, as many as COMMON and ENTRIES allow; terms said about equally often go together."""
    said = F.aggregate("entries", F.lit(0.0), lambda n, e: n + F.expm1(e["x"]))
    step = F.floor(8 * F.log2(said + 0.5)).alias("step")
    steps = model.terms.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("entries")).alias("entries")).orderBy(F.desc("step")).collect()
    least, terms, entries = float("inf"), 0, 0
    for row in steps:
        terms, entries = terms + row["n"], entries + row["entries"]
        if terms > COMMON or entries > ENTRIES:
            break
        least = row["step"]
    return model.terms.where(step >= F.lit(float(least))).select("term", "entries")


def _weighed(model: WordModel, rows: DataFrame) -> DataFrame:
    """(_id, length, sums, terms, counts) of (_id, _text): what the common terms add to a row's length and classes, and its other words."""
    held = _common_terms(model).toArrow()
    names, listed = held.column("term").combine_chunks(), held.column("entries").combine_chunks()
    cells, lengths = listed.flatten(), listed.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    shared = rows.sparkSession.sparkContext.broadcast((names, ends, cells.field(0).to_numpy(zero_copy_only=False), cells.field(1).to_numpy(zero_copy_only=False)))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, ends, classes, logs = shared.value
        n, flat, tf = batch.num_rows, batch.column("terms").flatten(), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        at = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False)
        known, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        begin, each = ends[at[known]], ends[at[known] + 1] - ends[at[known]]
        cell = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        width = int(classes.max()) + 1 if len(classes) else 1
        keys, place = np.unique(np.repeat(owner[known], each) * width + classes[cell], return_inverse=True)
        sums = np.bincount(place, weights=np.repeat(tf[known], each) * logs[cell], minlength=len(keys))
        offsets = lambda row: pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
        pair = pa.StructArray.from_arrays([pa.array(keys % width, pa.int32()), pa.array(sums, pa.float64())], names=["at", "x"])
        other = offsets(owner[rest])
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(np.bincount(owner[known], weights=tf[known], minlength=n).astype(np.int64)),
             pa.ListArray.from_arrays(offsets(keys // width), pair), pa.ListArray.from_arrays(other, flat.take(pa.array(rest))),
             pa.ListArray.from_arrays(other, pa.array(tf[rest], pa.int32()))], names=["_id", "length", "sums", "terms", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                yield weigh(batch.slice(first, ROWS))

    counted = spread(rows).select("_id", word_counts(words(F.col("_text"))).alias("w")).select("_id", "w.terms", "w.counts")
    kind = rows.schema["_id"].dataType.simpleString()
    return written(counted.mapInArrow(scan, f"_id {kind}, length long, sums array<struct<at:int,x:double>>, terms array<string>, counts array<int>"), "scored_words")


def score_words(model: WordModel, rows: DataFrame, key: str = "id", text: str = "string", top: int | None = None) -> DataFrame:
    """``rows`` with ``classes`` array<struct<label, prob>> in label order; words the model never saw are ignored. A row without a key
    counts as one without words.

    The COMMON terms are weighed where a row is read; only a row's rarer words are shuffled, to their term and back.
    With ``top`` only that many most probable classes, most probable first; their probabilities are still shares of all classes. log(0 + 1) is zero, so
    only terms a class has seen add to its sum and the join stays sparse. A row meets the classes in blocks; a block gives its highest score, the sum
    of its classes' shares and, with ``top``, no more classes than that.
    """
    weighed = _weighed(model, rows.select(F.col(key).alias("_id"), F.col(text).alias("_text")))
    rest = weighed.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    others = weighed.select("_id", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf"))).alias("e")).select("_id", "e.term", F.col("e.tf").cast("long").alias("tf"))
    hits = lookup_join(others, model.terms, "term", rest, "_id", "inner")
    length = weighed.select("_id", "length").unionByName(hits.select("_id", F.col("tf").alias("length"))).groupBy("_id").agg(F.sum("length").alias("length"))
    block = F.floor(F.col("at") / BLOCK).cast("int")
    added = hits.select("_id", "tf", F.explode("entries").alias("e")).select("_id", F.col("e.at").alias("at"), (F.col("tf") * F.col("e.x")).alias("x"))
    sums = weighed.select("_id", F.explode("sums").alias("e")).select("_id", "e.at", "e.x").unionByName(added).groupBy("_id", "at").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("_id", block.alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("sums"))
    listed = written(model.classes.groupBy(block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "label", "prior", "base"))).alias("listed")), "class_blocks")
    blocks = listed.count()
    ids = rows.select(F.col(key).alias("_id")).distinct().join(length, "_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))))
    met = ids.join(listed, "block").join(sums, ["_id", "block"], "left")
    seen = F.coalesce(F.col("length"), F.lit(0))
    score = lambda c: c["prior"] - seen * c["base"] + F.coalesce(F.try_element_at("sums", c["at"]), F.lit(0.0))
    met = met.select("_id", "block", F.transform("listed", lambda c: F.struct((-score(c)).alias("down"), c["at"].alias("at"), c["label"].alias("label"))).alias("scores"))
    met = met.withColumn("high", F.array_max(F.transform("scores", lambda s: -s["down"])))
    kept = F.col("scores") if top is None else F.slice(F.array_sort("scores"), 1, top)
    part = F.struct("block", "high", F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(-s["down"] - F.col("high"))).alias("total"), kept.alias("kept"))
    per_row = met.groupBy("_id").agg(F.collect_list(part).alias("_parts"))
    out = rows.join(per_row, F.col(key).eqNullSafe(F.col("_id")), "left")
    return out.withColumn("classes", _summed_up(F.col("_parts"), top)).drop("_id", "_parts")
