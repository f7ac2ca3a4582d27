"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; so there are at most 1 / SHARE hot keys.
SHARE, LEAST = 0.001, 1000


def skew_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of many rows with a table of one row a key (column `key` on both sides).

    The rows of hot keys meet a broadcast of at most 1 / `SHARE` rows; all others, and rows without a key, are dealt
    by key and by a hash of their own, so no task gets more than a small share."""
    names = [c for c in right.columns if c != key]
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = left.count()
    hot = counts.where(F.col("__n") > max(LEAST, total * SHARE)).select(F.col(key).alias("__hot"))
    hot = left.sparkSession.createDataFrame(hot.collect(), hot.schema)
    few = right.join(F.broadcast(hot), F.col(key) == F.col("__hot")).select(F.col("__hot"), *[F.col(c).alias(f"__few_{c}") for c in names])
    marked = left.join(F.broadcast(few), F.col(key) == F.col("__hot"), "left")
    rest = right.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__rest_{c}") for c in names])
    own = F.when(F.col("__hot").isNull(), F.col(key))
    apart = F.when(own.isNull(), F.xxhash64(*[F.col(c) for c in left.columns])).otherwise(F.lit(0))  # spreads rows that need no partner
    joined = marked.withColumn("__own", own).withColumn("__apart", apart).join(rest.withColumn("__zero", F.lit(0).cast("long")), (F.col("__own") == F.col("__key")) & (F.col("__apart") == F.col("__zero")), "left")
    return joined.select(*left.columns, *[F.coalesce(f"__few_{c}", f"__rest_{c}").alias(c) for c in names])
