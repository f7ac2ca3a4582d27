"""Near-duplicate groups: every document with its class of equal sets and its component of near ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.llm.components import connected_components
from corpusloom.llm.skew import skew_join
from corpusloom.llm.store import save
from corpusloom.operators import leakage as L


def near_duplicate_groups(docs: DataFrame, id_col: str, sets: Column, percent: int = 90) -> DataFrame:
    """(id, class_id, component_id, links) of every document, copies and loners too.

    A class is the documents of one set, named by its least id; a component joins classes by `near_duplicate_pairs`;
    links counts the other documents of a similarity of at least percent / 100.  Empty sets have null ids and no links."""
    s = F.sort_array(F.array_distinct(sets))
    each = save(docs.select(F.col(id_col).alias("id"), F.when(F.size(s) > 0, F.unhex(F.sha2(F.to_json(s), 256))).alias("key")))  # sets themselves travel for pairs only
    least = each.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    pairs = save(L.near_duplicate_pairs(docs, id_col, sets, percent).select("a", "b"))
    label = connected_components(pairs).select(F.col("node").alias("class_id"), F.col("label").alias("component_id"))
    size = least.select(F.col("class_id").alias("b"), "members")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size, "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("members").alias("near"))
    classes = least.join(label, "class_id", "left").join(near, "class_id", "left")
    classes = classes.select("key", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), (F.coalesce("near", F.lit(0)) + F.col("members") - 1).alias("links"))
    return skew_join(each, classes, "key").select("id", "class_id", "component_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The membership beside `near_duplicate_pairs`."""
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", T.tokens(F.col("text")))
