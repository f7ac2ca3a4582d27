"""Operator 10: language identification of web pages by Bayesian evidence fusion.

Four sources of evidence are added as log-probabilities of each language:
- text: naive Bayes over hashed byte trigrams of the visible text, learned by grouped
  counts from labelled documents;
- markup: the language that the page declares in its html tag;
- address: the language that the address names, as its country suffix, its first label
  or a path part of two letters;
- host: a prior for each host, smoothed towards its domain and that towards all pages.
How far a declaration can be trusted is counted, not set: for each declared language, how
often the text's own best guess is each language, with one pseudo-count a pair.  Host,
domain and global counts of text guesses are grouped aggregates (with a partial step, so a
host with a third of all pages is no hot task); a host's prior is (count + S * domain
prior) / (total + S), a domain's likewise from the global one, and the page's own guess
is taken out of its host's counts first.

Edge cases: null or empty html leaves the other evidence; null or broken addresses have
the empty host; unknown declarations are no evidence; ties go to the language that is
first by name; without labelled documents every language and posterior is null; empty
pages give an empty table; rows that share an id are judged each; pages of any length are
read whole, in linear time; other columns are not read, so clashing names cannot matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm.skew import skew_join
from corpusloom.llm.store import save

#: Hash buckets of trigrams, pseudo-count of a trigram, labelled documents at most for each language, and weight of the wider prior.
BUCKETS, ALPHA, MAX_LABELLED, S = 1 << 14, 0.5, 5_000, 5.0
#: Languages at most: a row of the model each.
MAX_LANGUAGES = 1_000
#: A text's trigrams count as so many independent ones at most, as neighbours overlap.
TRUST = 40.0


def _without(html: Column, opening: str, closing: str) -> Column:
    """Everything from an opening mark to the next closing one becomes a space; openings that are never closed stay.

    The text is cut at closing marks, and each piece is searched once, so the time is linear in the page."""

    def strip(pieces: Column) -> Column:
        inner = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.regexp_replace(p, f"{opening}(?s:.*)\\z", " "))
        return F.concat(F.array_join(inner, " "), F.when(F.size(pieces) > 1, " ").otherwise(""), F.element_at(pieces, -1))

    return F.get(F.transform(F.array(F.split(html, closing)), strip), F.lit(0))  # the pieces are made once


def visible(html: Column) -> Column:
    """Text of a page: scripts, styles, comments, navigation and tags become spaces."""
    html = F.coalesce(html.cast("string"), F.lit(""))
    for tag in ("script", "style", "head", "nav"):
        html = _without(html, rf"(?i)<{tag}\b[^<>]*>", rf"(?i)</{tag}\s*>")
    html = _without(html, "<!--", "-->")
    return F.regexp_replace(html, r"<[^<>]*>|&[a-zA-Z#0-9]{1,8};", " ")


def declared(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(html.cast("string"), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of lower-case byte trigrams of words, and the row of each, edges of words included."""
    b = K.to_block(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    buf = K.LOWER[b.buf]
    letter = (buf >= 128) | ((buf >= 97) & (buf <= 122))
    buf = np.where(letter, buf, 32).astype(np.uint64)
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), b.off
    g = (buf[:-2] << np.uint64(16)) | (buf[1:-1] << np.uint64(8)) | buf[2:]
    ok = letter[1:-1].copy()
    inner = b.off[1:-1]
    for edge in (inner - 1, inner - 2):
        edge = edge[(edge >= 0) & (edge < len(ok))]
        ok[edge] = False
    at = np.flatnonzero(ok)
    return (K.mix(g[at]) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(b.off, at, "right") - 1, b.off


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """Languages by name and their log-probabilities of each trigram bucket, from a bounded sample by least id hash in each language's share."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.groupBy(F.col(lang_col).alias("lang")).count().toArrow().to_pandas()  # as many rows as languages
    if not len(rows):
        return [], np.zeros((0, BUCKETS))
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"{len(rows)} languages; the model holds {MAX_LANGUAGES} at most")
    share = {lang: min(1.0, max_labelled / n) for lang, n in zip(rows["lang"], rows["count"], strict=True)}
    limit = F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(float(s)))])[F.col(lang_col)]
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    names = sorted(share)

    def run(batches):
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            which = np.array([names.index(x) for x in batch["lang"].to_pylist()], np.int64)
            for a in range(0, batch.num_rows, 1000):
                g, row, _ = _trigrams(batch["text"].slice(a, 1000))
                total += np.bincount(which[a : a + 1000][row] * BUCKETS + g, minlength=total.size).reshape(total.shape)
        k, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(total[k, bucket])], ["k", "bucket", "n"])

    counts = known.where(part < limit).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    table = np.full((len(names), BUCKETS), ALPHA)
    table[counts["k"].to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(rows: DataFrame, names: list[str], model: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep` and `evidence` (array<double>, a log-likelihood for each language) of column `text`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                g, row, _ = _trigrams(part["text"])
                n = np.bincount(row, minlength=part.num_rows)
                ll = np.stack([np.bincount(row, weights=m[g], minlength=part.num_rows) for m in shared.value], axis=1)
                ll = ll / np.maximum(n, 1)[:, None] * np.minimum(n, TRUST)[:, None]
                values = pa.FixedSizeListArray.from_arrays(pa.array(ll.ravel()), len(names)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), values], [*keep, "evidence"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", evidence array<double>")


def _best(values: Column) -> Column:
    """Place of the largest value, the first on ties."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def identify(pages: DataFrame, names: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 200_000) -> DataFrame:
    """Per row: page_id, lang, posterior (of that language), text_lang, declared_lang, address_lang, host."""
    k = len(names)
    if not k:
        none = F.lit(None).cast("string")
        return pages.select(F.col(id_col).cast("long").alias("page_id"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"), none.alias("text_lang"), none.alias("declared_lang"), none.alias("address_lang"), host(F.col(url_col)).alias("host"))
    known = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    code = lambda c: known[c]
    html, url = F.col(html_col), F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    labels = F.split(host(url), r"\.")
    parts = F.regexp_extract_all(F.regexp_replace(url, r"^[^/]*//[^/?#]*|[?#].*$", ""), F.lit(r"/([a-zA-Z]{2})(?=/|$)"), F.lit(1))
    named = F.filter(F.concat(F.array(F.element_at(labels, -1), F.element_at(labels, 1)), F.transform(parts, F.lower)), lambda x: F.array_contains(F.array(*map(F.lit, names)), x))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), visible(html).alias("text"), code(declared(html)).alias("said"), code(F.get(named, F.lit(0))).alias("address"), host(url).alias("host"))
    rows = save(text_evidence(rows, names, model, ["page_id", "said", "address", "host"]).withColumn("guess", _best(F.col("evidence"))))

    # how declarations and addresses go with the text's own guess: k x k tables
    def trust(col: str) -> np.ndarray:
        table = np.ones((k, k))
        for r in rows.where(F.col(col).isNotNull()).groupBy("guess", col).count().collect():
            table[r[0], r[1]] += r["count"]
        return np.log(table / table.sum(axis=1, keepdims=True))

    said, address = trust("said"), trust("address")

    def column(table: np.ndarray, which: Column) -> Column:
        by = F.array(*[F.array(*[F.lit(float(table[lang, j])) for lang in range(k)]) for j in range(k)])
        return F.coalesce(F.get(by, which), F.array(*[F.lit(0.0)] * k))

    zero = F.array(*[F.lit(0.0)] * k)
    domain = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    domain = F.when(F.size(F.split("host", r"\.")) >= 2, domain).otherwise(F.col("host"))
    rows = rows.withColumn("domain", domain)
    ones = [F.count_if(F.col("guess") == i).alias(f"c{i}") for i in range(k)]
    hosts = rows.groupBy("domain", "host").agg(*ones)
    total = hosts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(k)]).first()
    every = np.array([total[i] for i in range(k)], float) + 1.0
    every /= every.sum()
    domains = hosts.groupBy(F.col("domain").alias("d")).agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in range(k)])
    wide = skew_join(hosts, domains.withColumnRenamed("d", "domain"), "domain")  # a domain may have very many hosts
    prior = save(wide.select(F.col("host").alias("h"), F.array(*[f"c{i}" for i in range(k)]).alias("own"), F.array(*[f"d{i}" for i in range(k)]).alias("wide")))
    if prior.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(prior), F.col("host") == F.col("h"), "left")
    else:  # a host may hold a large share of all pages
        joined = skew_join(rows, prior.withColumnRenamed("h", "host"), "host")
    less = lambda a: F.transform(F.coalesce(a, zero), lambda x, i: (x - F.when(i == F.col("guess"), 1).otherwise(0)).cast("double"))
    joined = joined.withColumns({"own": less(F.col("own")), "wide": less(F.col("wide"))})
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    base = F.array(*[F.lit(float(x)) for x in every])
    joined = joined.withColumn("wide", F.transform(F.arrays_zip(F.col("wide").alias("a"), base.alias("b")), lambda z: (z["a"] + S * z["b"]) / (sum_of(F.col("wide")) + S)))
    joined = joined.withColumn("prior", F.transform(F.arrays_zip(F.col("own").alias("a"), F.col("wide").alias("b")), lambda z: F.log((z["a"] + S * z["b"]) / (sum_of(F.col("own")) + S))))
    joined = joined.withColumns({"e1": column(said, F.col("said")), "e2": column(address, F.col("address"))})
    fused = F.transform(F.arrays_zip("evidence", "prior", "e1", "e2"), lambda z: z["evidence"] + z["prior"] + z["e1"] + z["e2"])
    joined = joined.withColumn("fused", fused).withColumn("top", _best(F.col("fused")))
    norm = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("fused")))
    name = lambda c: F.get(F.array(*map(F.lit, names)), c)
    return joined.select("page_id", name(F.col("top")).alias("lang"), (1 / norm).alias("posterior"), name(F.col("guess")).alias("text_lang"), name(F.col("said")).alias("declared_lang"), name(F.col("address")).alias("address_lang"), "host")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), names, model)
