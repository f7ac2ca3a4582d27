"""Operator 6: benchmark decontamination with DataFrame and SQL functions only.

Benchmark items become windows of `window` words (a shorter item is one window).  Two
sets of hashes are broadcast: every half-window of a full window, and the first word of
every short item.  Documents are tokenised once and exploded by word inside one
generated stage; a half-window is looked up at every sixth word only, because each full
window holds one that starts there.  Only words that hit carry their surroundings on,
where each candidate window is compared as text.  A benchmark over `broadcast_rows` hashes is joined by
shuffle instead: keys travel with places only, hits are gathered by document and meet its words once, and
candidate windows are joined by their text; clean documents take no part in these joins.

Edge cases: null or empty text has no words and is clean; null items and items without
words are ignored; repeated items count once by their id; a repeated document id is one
document for each row of the input; an empty benchmark leaves every document clean;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.store import save

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents always match this key once, so that clean ones stay in the result.
_ALWAYS = -1


def ascii_words(text: Column) -> Column:
    """Lower-cases A-Z and returns the words; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, _AZ, _az)), F.lit(WORD), F.lit(1))


def _slice_key(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, start + j) for j in range(n)])


def benchmark_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (item_id, n, words as text) of every window of every item."""
    w = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), ascii_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at")
    return w.select("item_id", n.alias("n"), "w", at).select("item_id", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("words"), F.slice("w", F.col("at") + 1, F.col("n")).alias("w")).distinct()


def contaminated_windows(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row for each document and occurrence: doc_id, row_id, n_words, start, n, item_id; start is null in the row that every document has."""
    half = window // 2
    stride = window - half + 1
    bench = benchmark_windows(items, window, item_id, item_text)
    full = bench.where(F.col("n") == window)
    halves = full.select(F.explode(F.sequence(F.lit(0), F.lit(window - half))).alias("at"), "w").select(_slice_key(F.col("w"), F.col("at"), half).alias("key"))
    firsts = bench.where(F.col("n") < window).select(F.xxhash64(F.lit(1), F.get("w", F.lit(0))).alias("key"))
    spark = docs.sparkSession
    keys = halves.unionByName(firsts).unionByName(spark.range(1).select(F.lit(_ALWAYS).cast("long").alias("key"))).distinct()
    small = bench.groupBy().agg(F.count("*").alias("rows"), F.collect_set(F.when(F.col("n") < window, F.col("n"))).alias("lengths")).first()
    if small["rows"] * (window - half + 1) > broadcast_rows:
        return _by_shuffle(docs, bench, halves.unionByName(firsts).distinct(), sorted(small["lengths"] or []), window, id_col, text_col)
    keys = F.broadcast(keys)

    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), ascii_words(F.col(text_col)).alias("w"))
    each = words.select("doc_id", "row_id", "w", F.posexplode_outer("w").alias("pos", "word"))
    pos, short = F.col("pos"), F.xxhash64(F.lit(1), F.col("word"))
    cand = F.array()
    on_grid = (pos % stride == 0) & (pos + half <= F.size("w"))
    long_key = _slice_key(F.col("w"), pos, half)
    always = F.lit(_ALWAYS).cast("long")
    start = pos.isNull() | (pos == 0)
    if small["lengths"]:
        cand = F.when(start & on_grid, F.array(always, long_key, short)).when(pos.isNull(), F.array(always)).when(start, F.array(always, short)).when(on_grid, F.array(long_key, short)).otherwise(F.array(short))
    else:
        each = each.where(start | on_grid)
        cand = F.when(pos.isNull(), F.array(always)).when(start & on_grid, F.array(always, long_key)).when(start, F.array(always)).otherwise(F.array(long_key))
    looked = each.select("doc_id", "row_id", "w", "pos", F.explode(cand).alias("key"), on_grid.alias("grid"))
    hits = looked.join(keys, "key")

    # candidate windows around each hit: full ones that hold the half-window, short ones that start here
    lengths = sorted(small["lengths"] or [])
    first = F.greatest(F.lit(0), pos - (stride - 1))
    last = F.least(pos, F.size("w") - window)
    around = F.when(F.col("grid") & (last >= first), F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("start"), F.lit(window).alias("n"))))
    here = F.filter(F.array(*[F.struct(pos.alias("start"), F.lit(n).alias("n")) for n in lengths]), lambda x: x["start"] + x["n"] <= F.size("w")) if lengths else None
    spans = F.coalesce(around, F.array().cast("array<struct<start:int,n:int>>"))
    spans = F.concat(spans, here) if here is not None else spans
    is_always = F.col("key") == _ALWAYS
    tried = hits.select("doc_id", "row_id", F.size("w").alias("n_words"), "w", F.explode_outer(F.when(~is_always, spans)).alias("s"), is_always.alias("always")).where(F.col("always") | F.col("s").isNotNull())
    texts = tried.select("doc_id", "row_id", "n_words", F.col("s.start").alias("start"), F.col("s.n").alias("n"), F.when(F.col("s").isNotNull(), F.array_join(F.slice("w", F.col("s.start") + 1, F.col("s.n")), " ")).alias("words"), "always")
    verify = bench.select("item_id", F.col("n").alias("bn"), F.col("words").alias("bw"))
    verify = F.broadcast(verify)
    return texts.join(verify, (F.col("words") == F.col("bw")) & (F.col("n") == F.col("bn")), "left").where(F.col("always") | F.col("item_id").isNotNull()).select("doc_id", "row_id", "n_words", "start", "n", "item_id")


def _by_shuffle(docs: DataFrame, bench: DataFrame, keys: DataFrame, lengths: list[int], window: int, id_col: str, text_col: str) -> DataFrame:
    """The same rows for a benchmark too large to broadcast.  Rows are numbered once, in a saved table."""
    half = window // 2
    stride = window - half + 1
    words = save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text_col).alias("text")))
    words = words.select("doc_id", "row_id", ascii_words(F.col("text")).alias("w"))
    each = words.select("row_id", "w", F.posexplode("w").alias("pos", "word"))
    pos = F.col("pos")
    on_grid = (pos % stride == 0) & (pos + half <= F.size("w"))
    key = F.when(on_grid, F.array(_slice_key(F.col("w"), pos, half))).otherwise(F.array().cast("array<bigint>"))
    key = F.concat(key, F.array(F.xxhash64(F.lit(1), F.col("word")))) if lengths else key
    hits = each.select("row_id", "pos", F.explode(key).alias("key")).join(keys, "key").groupBy("row_id").agg(F.collect_set("pos").alias("places"))
    first = lambda p: F.greatest(F.lit(0), p - (stride - 1))
    last = lambda p: F.least(p, F.size("w") - window)
    none = F.array().cast("array<struct<start:int,n:int>>")
    full = lambda p: F.when((p % stride == 0) & (last(p) >= first(p)), F.transform(F.sequence(first(p), last(p)), lambda s: F.struct(s.alias("start"), F.lit(window).alias("n")))).otherwise(none)
    here = lambda p: F.filter(F.array(*[F.struct(p.alias("start"), F.lit(n).alias("n")) for n in lengths]), lambda x: x["start"] + x["n"] <= F.size("w"))
    spans = F.array_distinct(F.flatten(F.transform("places", lambda p: F.concat(full(p), here(p)) if lengths else full(p))))
    tried = words.join(hits, "row_id").select("doc_id", "row_id", F.size("w").alias("n_words"), "w", F.explode(spans).alias("s"))
    texts = tried.select("doc_id", "row_id", "n_words", F.col("s.start").alias("start"), F.col("s.n").alias("n"), F.array_join(F.slice("w", F.col("s.start") + 1, F.col("s.n")), " ").alias("words"))
    verify = bench.select("item_id", F.col("n").alias("bn"), F.col("words").alias("bw"))
    found = texts.join(verify, (F.col("words") == F.col("bw")) & (F.col("n") == F.col("bn"))).select("doc_id", "row_id", "n_words", "start", "n", "item_id")
    lone = words.select("doc_id", "row_id", F.size("w").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("n"))
    return lone.withColumn("item_id", F.lit(None).cast(bench.schema["item_id"].dataType)).unionByName(found)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence), item_ids (sorted as strings), hit_spans (merged word runs [start, end)), contaminated."""
    found = contaminated_windows(docs, items, window, id_col, text_col, item_id, item_text, broadcast_rows)
    order = Window.partitionBy("row_id").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start").isNotNull() & (reach.isNull() | (reach < F.col("start")))
    runs = found.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("row_id", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("n")).alias("end"),
        F.collect_set(F.col("item_id").cast("string")).alias("ids"),
    )
    per = merged.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"),
        F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("hit_spans"),
    )
    return per.select("doc_id", "n_words", "n_hit", "item_ids", "hit_spans", (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of `docs` whose document holds no benchmark window; every column is kept."""
    bad = decontaminate(docs, items, id_col=id_col, **names).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__bad")), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    d = decontaminate(docs, items)
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, (SELECT unnest(range(10)) AS j) WHERE j < n GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
