"""Joins whose many-side may hold a large share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task handles without trouble. It does not grow with the data: a key with more is spread over as many salts as it needs.
LIMIT = 100_000


def salted_join(many: DataFrame, one: DataFrame, key: str, rows_per_key: str, total: int,
                spread_by: str, how: str = "inner") -> DataFrame:
    """Join ``many`` to ``one`` (unique on ``key``), spreading hot keys over several tasks.

    ``one[rows_per_key]`` holds how many rows of ``many`` carry the key and ``total`` bounds their sum. A key with more than LIMIT rows is dealt over
    ceil(rows / LIMIT) salts; only its row of ``one`` is repeated, once per salt. The salt counts reach the rows by a join with the hot keys, at most
    total / LIMIT of them, whose measured size decides whether they are broadcast.
    """
    if total <= LIMIT:
        return many.join(one, key, how)
    salts = F.greatest(F.ceil(F.col(rows_per_key) / LIMIT), F.lit(1)).cast("int")
    hot = one.where(F.col(rows_per_key) > LIMIT).select(key, salts.alias("_salts"))
    left = (
        many.join(hot, key, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int")).otherwise(F.lit(0)))
        .drop("_salts")
    )
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def lookup_join(many: DataFrame, one: DataFrame, key: str, total: int, spread_by: str, how: str = "left") -> DataFrame:
    """``salted_join`` for a many-side whose key sizes are not known yet; small inputs join directly."""
    if total <= LIMIT:
        return many.join(one, key, how)
    sizes = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    sized = one.join(sizes, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return salted_join(many, sized, key, "_n", total, spread_by, how).drop("_n")
