"""Operator 2: quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets counts over its words.  Its rule metrics (mean word length, symbols a
word, repeated-line share, repeated-word share) go into logarithmic histograms for each
language and source: a bucket is a fixed relative width, so sketches merge by adding
counts, which is a grouped aggregate with a partial step; a group sends at most one row a
bucket and task, however many documents it has.  From the merged sketch of a group come
its median and upper and lower quantiles; the thresholds lie `FENCE` times the distance of
the quantile from the median beyond it, and at least `SLACK` above it, so a uniform group
rejects nothing.  The thresholds join back to the documents, and the filter follows.

Edge cases: null text counts as empty, has no words and fails the base rule; null
languages and sources are groups of their own; a group of under `least` documents (a
parameter, 50 unless set: fewer give no quantiles to speak of) uses the sketch of all
groups; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm.store import save

#: Buckets for each factor of e; quantile on either side of the median; distance of the fence; least spread; least group.
RESOLUTION, QUANTILE, FENCE, LEAST = 32, 0.1, 4.0, 50
#: Metrics, the side they are judged on, and the least distance of a fence from the median.
METRICS = {"word_chars_mean": ("both", 2.0), "symbol_ratio": ("high", 0.1), "dup_line_ratio": ("high", 0.3), "repeat_word_ratio": ("high", 0.1)}
#: A threshold table of at most so many rows is broadcast.
BROADCAST_GROUPS = 100_000
_COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _line_counts(buf, off, starts, first):
    """(lines with a word, of them equal to an earlier line) of each document."""
    n = len(off) - 1
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    new = np.flatnonzero(buf == 10)
    for d in range(n):
        a, b = int(off[d]), int(off[d + 1])
        ws = starts[first[d] : first[d + 1]]
        if not len(ws):
            continue
        inner = new[np.searchsorted(new, a) : np.searchsorted(new, b)]
        if not len(inner):
            lines[d] = 1
            continue
        edge = np.concatenate([[a - 1], inner, [b]])
        with_word = np.diff(np.searchsorted(ws, edge)) > 0
        text = bytes(buf[a:b])
        own = [text[edge[i] + 1 - a : edge[i + 1] - a] for i in np.flatnonzero(with_word)]
        lines[d] = len(own)
        dup[d] = len(own) - len(set(own))
    return lines, dup


def _batch_counts(b: K.Block):
    out = []
    for d, e, x, y in b.pieces(1 << 22):
        buf, off = b.buf[x:y], b.off[d : e + 1] - x
        s, t, first = K.words(buf, off)
        per = lambda flags, off=off: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
        is_word = ~K.SPACE[buf]
        chars = per(is_word & ((buf & 0xC0) != 0x80))
        symbols = per(_SYMBOL[buf])
        h = K.hash_words(buf, s, t)
        grams = K.hash_windows(h, 5)
        again = np.zeros(len(s), bool)
        for i in range(e - d):
            w, z = int(first[i]), int(first[i + 1])
            if z - w < 6:
                continue
            own, index, count = np.unique(grams[w : z - 4], return_inverse=True, return_counts=True)
            if len(own) < z - w - 4:
                at = np.flatnonzero(count[index] > 1)
                again[w:z] = K.covered(z - w, at, at + 5)
        repeat = np.diff(np.concatenate([[0], np.cumsum(again)])[first])
        lines, dup = _line_counts(buf, off, s, first)
        out.append((np.diff(first), chars, symbols, dup, lines, repeat))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every document: words, their code points, symbols, repeated lines, lines, words in repeated 5-word windows."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = pa.table({"doc_id": pa.array(range(part.num_rows), pa.int64()), "text": part["text"]})
                cols = _batch_counts(K.to_block(rows))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"], part["source"], *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _COUNTS)


def metric_columns() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "word_chars_mean": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_word_ratio": share("n_repeat_words", "n_words"),
    }


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Merged histograms: (keys, metric, bucket, n); bucket b stands for values up to exp(b / RESOLUTION) - 0.001."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.ceil(F.log(c + 0.001) * RESOLUTION).cast("int").alias("bucket")) for m, c in metric_columns().items()])).alias("m"))
    return long.groupBy(*keys, "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def quantiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, total, low, mid, high) of each sketch."""
    by = Window.partitionBy(*keys, "metric")
    upto = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    value = F.exp(F.col("bucket") / RESOLUTION) - 0.001
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value))
    return upto.groupBy(*keys, "metric").agg(F.first("total").alias("total"), at(QUANTILE).alias("low"), at(0.5).alias("mid"), at(1 - QUANTILE).alias("high"))


def thresholds(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each language and source: the allowed range of each metric; groups of under `least` documents use the sketch of all."""
    merged = sketch(rows, ["lang", "source"])
    own = quantiles(merged, ["lang", "source"])
    every = quantiles(merged.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), []).select("metric", *[F.col(c).alias(f"all_{c}") for c in ("low", "mid", "high")])
    own = own.join(F.broadcast(every), "metric")
    pick = {c: F.when(F.col("total") >= least, F.col(c)).otherwise(F.col(f"all_{c}")) for c in ("low", "mid", "high")}
    slack = F.create_map(*[x for m, (_, s) in METRICS.items() for x in (F.lit(m), F.lit(s))])[F.col("metric")]
    top = pick["mid"] + F.greatest(FENCE * (pick["high"] - pick["mid"]), slack)
    bottom = pick["mid"] - F.greatest(FENCE * (pick["mid"] - pick["low"]), slack)
    wide = own.select("lang", "source", "metric", top.alias("top"), bottom.alias("bottom"))
    pivot = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("top", "bottom")]
    return wide.groupBy("lang", "source").agg(*pivot)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST) -> DataFrame:
    """Per row: counts, metrics, base_failed, failed (array of metrics outside their thresholds) and kept."""
    rows = save(text_counts(docs, id_col, text_col, lang_col, source_col))  # small: the texts are read once
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    limits = save(thresholds(rows.where("NOT base_failed"), least))
    limits = limits.withColumnsRenamed({"lang": "l_lang", "source": "l_source"})
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    rows = rows.withColumns(metric_columns()).join(limits, F.col("lang").eqNullSafe(F.col("l_lang")) & F.col("source").eqNullSafe(F.col("l_source")), "left")
    rules = []
    for m, (side, _) in METRICS.items():
        out = F.col(m) > F.col(f"{m}_top")
        if side == "both":
            out = out | (F.col(m) < F.col(f"{m}_bottom"))
        rules.append(F.when(out, F.lit(m)))
    rows = rows.withColumn("failed", F.array_compact(F.array(*rules)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("l_lang", "l_source")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1),
rc AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lc USING (doc_id) LEFT JOIN rc USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  coalesce(word_chars / nullif(n_words, 0), 0.0) AS m1, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS m2, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS m3, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS m4 FROM c),
v AS (SELECT lang, source, u.k AS k, u.s AS s, ceil(ln(u.x + 0.001) * {RESOLUTION}) AS b FROM (SELECT lang, source, unnest([{{'k': 1, 's': 2.0, 'x': m1}}, {{'k': 2, 's': 0.1, 'x': m2}}, {{'k': 3, 's': 0.3, 'x': m3}}, {{'k': 4, 's': 0.1, 'x': m4}}]) AS u FROM m WHERE NOT base_failed)),
h AS (SELECT lang, source, k, s, b, count(*) AS n FROM v GROUP BY ALL),
hu AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, k ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, k) AS total FROM h),
q AS (SELECT lang, source, k, any_value(s) AS s, any_value(total) AS total, min(exp(b / {RESOLUTION}) - 0.001) FILTER (upto >= ceil(total * {QUANTILE})) AS lo, min(exp(b / {RESOLUTION}) - 0.001) FILTER (upto >= ceil(total * 0.5)) AS mid, min(exp(b / {RESOLUTION}) - 0.001) FILTER (upto >= ceil(total * {1 - QUANTILE})) AS hi FROM hu GROUP BY lang, source, k),
au AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY b) AS upto, sum(n) OVER (PARTITION BY k) AS total FROM (SELECT k, b, sum(n) AS n FROM h GROUP BY k, b)),
aq AS (SELECT k, min(exp(b / {RESOLUTION}) - 0.001) FILTER (upto >= ceil(total * {QUANTILE})) AS lo, min(exp(b / {RESOLUTION}) - 0.001) FILTER (upto >= ceil(total * 0.5)) AS mid, min(exp(b / {RESOLUTION}) - 0.001) FILTER (upto >= ceil(total * {1 - QUANTILE})) AS hi FROM au GROUP BY k),
t AS (SELECT lang, source, k, mid + greatest({FENCE} * (hi - mid), s) AS top, mid - greatest({FENCE} * (mid - lo), s) AS bottom
  FROM (SELECT lang, source, q.k, s, CASE WHEN total >= {LEAST} THEN q.lo ELSE aq.lo END AS lo, CASE WHEN total >= {LEAST} THEN q.mid ELSE aq.mid END AS mid, CASE WHEN total >= {LEAST} THEN q.hi ELSE aq.hi END AS hi FROM q JOIN aq USING (k)))
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(m1 > t1.top OR m1 < t1.bottom OR m2 > t2.top OR m3 > t3.top OR m4 > t4.top, false) AS kept
FROM m LEFT JOIN t t1 ON t1.k = 1 AND m.lang IS NOT DISTINCT FROM t1.lang AND m.source IS NOT DISTINCT FROM t1.source
LEFT JOIN t t2 ON t2.k = 2 AND m.lang IS NOT DISTINCT FROM t2.lang AND m.source IS NOT DISTINCT FROM t2.source
LEFT JOIN t t3 ON t3.k = 3 AND m.lang IS NOT DISTINCT FROM t3.lang AND m.source IS NOT DISTINCT FROM t3.source
LEFT JOIN t t4 ON t4.k = 4 AND m.lang IS NOT DISTINCT FROM t4.lang AND m.source IS NOT DISTINCT FROM t4.source
"""
