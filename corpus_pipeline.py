"""The corpus pipeline: toxicity, near duplicates, repeated strings, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
Filtering stages keep the columns of `documents`; the substring stage shortens `text` and
sets `n_chars` to its new length; the last stage returns doc_id, n_tokens and ids.
Rows with a null id are kept or dropped by the same rules; rows that share an id are
judged together.  Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard_join, sentencepiece_lattice, suffix_dedup, toxicity
from corpusloom.llm.store import save


def _matching(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose id is (or is not) in ids(__id); null matches null."""
    return docs.join(ids.distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = toxicity.score_toxicity(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("__id"))
    return _matching(docs, bad, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    groups = jaccard_join.jaccard_components(docs)
    later = groups.where("doc_id <> component_id OR (doc_id IS NOT NULL AND component_id IS NULL)").select(F.col("doc_id").alias("__id"))
    return _matching(docs, later, "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 50 bytes that an earlier document holds are cut out of later ones; texts without cuts stay as they are."""
    rest = [c for c in docs.columns if c != "text"]
    null = "_".join(["is_null", *rest])  # no column's name
    rows = suffix_dedup.suffix_dedup(docs.withColumn(null, F.col("text").isNull()), keep=[*rest, null])  # rows travel whole, so nothing is joined back
    raw = F.col("kept").cast("string")  # a cut may leave parts of a character; they go too
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long"))
    out = {c: F.col("row").getField(c) for c in rest}
    if "n_chars" in out:
        out["n_chars"] = F.coalesce(size, out["n_chars"])
    rows = rows.withColumn("text", F.when(F.col("n_removed") > 0, text).when(~F.col("row").getField(null), raw))
    return rows.select(*[F.col("text") if c == "text" else out[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a single word or a bare number is no leak."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = decontaminate.ascii_words(F.col("text"))
    items = items.where((F.size(words) >= 10) | ((F.size(words) >= 2) & F.exists(words, lambda w: w.rlike("[^0-9]"))))
    return decontaminate.remove_contaminated(docs, items)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text."""
    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.default_model()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokens),
]

#: The first stage scores by a trained model, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs)
    return docs
