"""Corpus statistics, histograms, classes, strata, fits and distances as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import classes as C
from corpusloom.functions import text as T


def file_stats(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines, characters, tokens, types, type-token ratio, hapaxes, and least, median, mean and greatest line length."""
    words = lines.select(*by, F.explode(T.tokens(F.col("line"))).alias("w")).groupBy(*by, "w").count()
    vocab = words.groupBy(*by).agg(F.sum("count").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("count") == 1).alias("hapax"))
    n = F.char_length("line")
    size = lines.groupBy(*by).agg(F.count("*").alias("lines"), F.sum(n).alias("characters"), F.min(n).alias("min_len"), F.median(n).alias("median_len"), F.avg(n).alias("mean_len"), F.max(n).alias("max_len"))
    out = size.join(vocab, by, "left") if by else size.crossJoin(vocab)
    return out.fillna(0, ["tokens", "types", "hapax"]).withColumn("ttr", T.ratio(F.col("types"), F.col("tokens")))


def char_classes(lines: DataFrame) -> DataFrame:
    """(class, n) over all characters."""
    chars = lines.select(F.explode(T.characters(F.col("line"))).alias("c")).groupBy("c").count()
    return chars.groupBy(T.char_class(F.col("c")).alias("class")).agg(F.sum("count").alias("n"))


def letter_frequencies(lines: DataFrame, alphabet: str) -> DataFrame:
    """(letter, n) for every letter of an alphabet, zero where it does not occur."""
    spark = lines.sparkSession
    letters = spark.createDataFrame([(c,) for c in alphabet], "letter string")
    found = lines.select(F.explode(T.characters(F.lower("line"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    return F.broadcast(letters).join(found, "letter", "left").fillna(0, ["n"])


def length_histogram(lines: DataFrame, kind: str = "open") -> DataFrame:
    """(bin, n) of line lengths, five wide.

    open: zero filled up to the longest; sparse: last bin 55, only bins with lines; fixed: 0-5 to 50-55, last one closed by everything longer, zero filled."""
    low = (F.floor(F.char_length("line") / 5) * 5).cast("long")
    if kind == "sparse":
        return lines.groupBy(F.least(low, F.lit(55)).alias("bin")).agg(F.count("*").alias("n"))
    if kind == "fixed":
        low = F.least(low, F.lit(50))
    own = lines.groupBy(low.alias("bin")).agg(F.count("*").alias("n"))
    top = F.lit(50).cast("long") if kind == "fixed" else F.coalesce(F.max("bin"), F.lit(0))
    every = own.agg(top.alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), "top", F.lit(5).cast("long"))).alias("bin"))
    return every.join(own, "bin", "left").fillna(0, ["n"])


def class_lines(lines: DataFrame, table: dict[str, str] = C.TOKEN_CLASSES) -> DataFrame:
    """(class, n): lines that hold each class, in one pass."""
    flagged = lines.select("line", *[c.alias(n) for n, c in C.class_flags(F.col("line")).items()])
    one = flagged.agg(*C.class_counts(F.col("line"), table))
    return one.unpivot([], list(table), "class", "n")


def rule_counts(rows: DataFrame, rules: dict[str, Column], name: str = "rule") -> DataFrame:
    """(rule, n): rows for which each rule holds, in one pass, zero where none does."""
    return rows.agg(*[F.count_if(c).alias(k) for k, c in rules.items()]).unpivot([], list(rules), name, "n")


def mark_kinds(lines: DataFrame) -> DataFrame:
    return lines.groupBy(C.mark_kind_count(F.col("line")).alias("kinds")).agg(F.count("*").alias("n"))


def rate_bands(counts: DataFrame, bands: dict[str, tuple[float, float]], total: int) -> DataFrame:
    """(class, n, rate, ok) against a least and a greatest share."""
    spark = counts.sparkSession
    limits = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in bands.items()], "class string, least double, most double")
    return F.broadcast(limits).join(counts, "class", "left").fillna(0, ["n"]).withColumn("rate", T.ratio(F.col("n"), F.lit(total))).withColumn("ok", (F.col("rate") >= F.col("least")) & (F.col("rate") <= F.col("most")))


def top_words(lines: DataFrame, k: int) -> DataFrame:
    """(word, n, first_pos): the k commonest words; ties by first place."""
    pos = F.struct("id", "line_no", "pos")
    words = lines.select("id", "line_no", F.posexplode(T.tokens(F.col("line"))).alias("pos", "word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min(pos).alias("first_pos")).orderBy(F.desc("n"), "first_pos").limit(k)


# ---- strata ----


def stratum_counts(rows: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n, share) for several dimensions in one pass; null is a value."""
    total = rows.agg(F.count("*").alias("total"))
    long = rows.unpivot([], [F.col(d).cast("string").alias(d) for d in dims], "dimension", "value")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("dimension", "value", "n", T.ratio(F.col("n"), F.col("total")).alias("share"))


def cross_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def largest_share(rows: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n, share) of each dimension's largest stratum; the first value by name on ties."""
    counts = stratum_counts(rows, dims)
    best = counts.groupBy("dimension").agg(F.min(F.struct((-F.col("n")).alias("k"), "value", "n", "share")).alias("b"))
    return best.select("dimension", "b.value", "b.n", "b.share")


def distinct_values(rows: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, n); null counts as a value."""
    one = rows.agg(*[(F.count_distinct(d) + F.max(F.col(d).isNull().cast("int"))).alias(d) for d in dims])
    return one.unpivot([], dims, "dimension", "n")


def span_summary(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Least and greatest key, distinct keys, rows and the longest run of consecutive keys.

    Gaps and islands over distinct keys, first in ranges of keys that are dealt to many tasks, then over the ranges."""
    keys = rows.select(*by, F.col(key).cast("long").alias("k")).distinct()
    part = [*by, F.floor(F.col("k") / 4096)]
    island = F.col("k") - F.row_number().over(Window.partitionBy(*part).orderBy("k"))
    local = keys.withColumn("part", F.floor(F.col("k") / 4096)).withColumn("island", island).groupBy(*by, "part", "island").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    w = Window.partitionBy(*by).orderBy("a")
    joined = local.withColumn("new", F.coalesce((F.col("a") != F.lag("b").over(w) + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    longest = joined.groupBy(*by, "run").agg((F.max("b") - F.min("a") + 1).alias("len")).groupBy(*by).agg(F.max("len").alias("longest_run"))
    size = rows.groupBy(*by).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count_distinct(key).alias("distinct_keys"), F.count("*").alias("n"))
    return size.join(longest, by) if by else size.crossJoin(longest)


def reviewed_share(rows: DataFrame, reviews: DataFrame, key: str, by: list[str], mark: str) -> DataFrame:
    """(by, total, reviewed, share): rows with a review of their key."""
    own = reviews.where(F.col(mark).isNotNull()).select(key).distinct().withColumn("__r", F.lit(1))
    return rows.join(own, key, "left").groupBy(*by).agg(F.count("*").alias("total"), F.count("__r").alias("reviewed")).withColumn("share", T.ratio(F.col("reviewed"), F.col("total")))


def stratum_delta(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, a_n, b_n, a_share, b_share, delta, missing_in) of two sides, each by its own total."""

    def shares(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy(by).agg(F.count("*").alias(f"{name}_n")).crossJoin(F.broadcast(d.agg(F.count("*").alias("t")))).select(by, f"{name}_n", T.ratio(F.col(f"{name}_n"), F.col("t")).alias(f"{name}_share"))

    both = shares(a, "a").join(shares(b, "b"), by, "full_outer").fillna(0, ["a_n", "b_n"]).fillna(0.0, ["a_share", "b_share"])
    return both.withColumn("delta", F.col("a_share") - F.col("b_share")).withColumn("missing_in", F.when(F.col("a_n") == 0, "a").when(F.col("b_n") == 0, "b"))


def warning_bands(metrics: DataFrame, bands: list[tuple[str, float, float]]) -> DataFrame:
    """(metric, value, level): ok, warn from the first limit on, hold from the second on."""
    spark = metrics.sparkSession
    table = spark.createDataFrame(bands, "metric string, warn double, hold double")
    level = F.when(F.col("value") >= F.col("hold"), "hold").when(F.col("value") >= F.col("warn"), "warn").otherwise("ok")
    return metrics.join(F.broadcast(table), "metric").select("metric", "value", level.alias("level"))


def mix_gaps(layers: dict[str, DataFrame], key: str, wanted: DataFrame) -> DataFrame:
    """(key, class, n for each layer, reason): required, preferred and excluded strata against each layer in order."""
    out = wanted.select(key, "class")
    for name, d in layers.items():
        out = out.join(d.groupBy(key).agg(F.count("*").alias(name)), key, "full_outer")
    names = list(layers)
    out = out.fillna(0, names)
    reason = F.when((F.col("class") == "excluded") & reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names]), "excluded_present")
    for n in names:
        reason = reason.when((F.col("class") == "required") & (F.col(n) == 0), f"required_missing_in_{n}")
    for n in names:
        reason = reason.when((F.col("class") == "preferred") & (F.col(n) == 0), f"preferred_missing_in_{n}")
    return out.withColumn("reason", reason.when(F.col("class").isNull(), "undeclared"))


def cap_decision(counts: DataFrame, key: str, caps: DataFrame) -> DataFrame:
    """(key, n, share, status, reason) of strata (key, n) against share and absolute caps."""
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.join(caps, key, "left").crossJoin(F.broadcast(total)).withColumn("share", T.ratio(F.col("n"), F.col("total")))
    over_n, over_s = F.col("n") > F.col("max_n"), F.col("share") > F.col("max_share")
    none = F.col("max_n").isNull() & F.col("max_share").isNull()
    status = F.when(none, "uncapped").when(over_n | over_s, "over_cap").when((F.col("n") == F.col("max_n")), "at_cap").otherwise("within_cap")
    reason = F.when(none, "no_cap_declared").when(over_n & over_s, "absolute_and_share_cap").when(over_n, "absolute_cap").when(over_s, "share_cap")
    return rows.select(key, "n", "share", status.alias("status"), reason.alias("reason"))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in characters.

    A character that the other side never has costs an edit each, and places that differ are enough edits for equal
    lengths; where the two bounds meet, the quadratic comparison is not needed."""
    least = F.greatest(*(F.char_length(F.call_function("translate", x, y, F.lit(""))) for x, y in ((a, b), (b, a))))
    places = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    return F.when((F.char_length(a) == F.char_length(b)) & (places == least), least).otherwise(F.levenshtein(a, b))


def stratified_cer(rows: DataFrame, by: list[str], ref: str, hyp: str) -> DataFrame:
    """(by, chars, edits, cer): errors over characters of each stratum, never one mixed number."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    each = rows.select(*by, bare(ref).alias("__r"), bare(hyp).alias("__h"))
    sums = each.groupBy(*by).agg(F.sum(F.char_length("__r")).alias("chars"), F.sum(edit_distance(F.col("__r"), F.col("__h"))).alias("edits"))
    return sums.withColumn("cer", T.ratio(F.col("edits"), F.col("chars")))


# ---- fits and distances ----


def quantile_fit(rows: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.1, 0.5, 0.9), least: int = 3) -> DataFrame:
    """(by, n, p10 ...): exact linear quantiles of groups with at least `least` values."""
    cols = [F.percentile(value, F.lit(q)).alias(f"p{round(q * 100):02d}") for q in points]
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), *cols).where(F.col("n") >= least)


def ks_wasserstein(rows: DataFrame, value: str, side: str, a: str, b: str, ranges: int = 64) -> DataFrame:
    """One row: the greatest gap (ks) and the area (w1) between two cumulative distributions.

    Counts of distinct values are summed by `ranges` ranges of values; only the ranges' totals are carried across."""
    knots = rows.where(F.col(side).isin(a, b) & F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(F.col(side) == a).alias("na"), F.count_if(F.col(side) == b).alias("nb"))
    bounds = [] if ranges < 2 else knots.stat.approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.001)  # any cut is right; it only evens the ranges
    at = F.lit(0)
    for b in sorted(set(bounds)):
        at = at + (F.col("x") > b).cast("int")
    cut = knots.withColumn("r", at)
    # a row for each range: its totals, and where the next range with values begins
    per = cut.groupBy("r").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.min("x").alias("first"))
    up = Window.orderBy("r")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    carried = per.select("r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in ("na", "nb")], F.sum("na").over(whole).alias("ta"), F.sum("nb").over(whole).alias("tb"), F.lead("first").over(up).alias("next"))
    w = Window.partitionBy("r").orderBy("x")
    cum = cut.join(F.broadcast(carried), "r").withColumn("ca", F.col("bna") + F.sum("na").over(w)).withColumn("cb", F.col("bnb") + F.sum("nb").over(w)).withColumn("dx", F.coalesce(F.lead("x").over(w), "next") - F.col("x"))
    gap = F.abs(T.ratio(F.col("ca"), F.col("ta")) - T.ratio(F.col("cb"), F.col("tb")))
    return cum.agg(F.max(gap).alias("ks"), F.coalesce(F.sum(gap * F.col("dx")), F.lit(0.0)).alias("w1"))


def bootstrap(rows: DataFrame, cluster: str, a_err: str, b_err: str, size: str, draws: int = 10_000, seed: int = 0, chunk: int = 1_000) -> DataFrame:
    """One row: rates of two readers, their difference and its 2.5 and 97.5 percentiles over k of k clusters drawn with replacement.

    Clusters are summed in Spark and dealt into chunks of about `chunk`.  How many of a draw's k picks fall into each
    chunk is multinomial; given that, a chunk picks among its own clusters alone, so draws are sums that any task can
    add to and no list of clusters is gathered.  A single chunk draws all picks at once from the seed."""
    import numpy as np
    import pandas as pd

    sums = rows.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.sum(a_err).cast("double").alias("a"), F.sum(b_err).cast("double").alias("b"), F.sum(size).cast("double").alias("n"))
    k = sums.count()
    parts = max(1, -(-k // chunk))
    sums = sums.withColumn("chunk", F.pmod(F.xxhash64("cluster"), F.lit(parts)))
    have = {r["chunk"]: r["m"] for r in sums.groupBy("chunk").agg(F.count("*").alias("m")).collect()} if parts > 1 else {0: k}
    order = sorted(have)
    share = np.random.default_rng([seed, 1]).multinomial(k, [have[c] / k for c in order], size=draws) if parts > 1 else None
    picks = {c: share[:, i] for i, c in enumerate(order)} if parts > 1 else {}

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("cluster")
        values, m, c = own[["a", "b", "n"]].to_numpy(), len(own), int(own["chunk"].iloc[0])
        total = np.empty((draws + 1, 3))
        rng = np.random.default_rng(seed if parts == 1 else [seed, 2, c])
        if parts == 1:
            index = rng.integers(0, m, size=(draws, m))
            for i in range(draws):
                total[i] = np.bincount(index[i], minlength=m) @ values
        else:
            for i, n in enumerate(picks[c]):
                total[i] = np.bincount(rng.integers(0, m, size=n), minlength=m) @ values
        total[draws] = values.sum(axis=0)
        return pd.DataFrame({"draw": np.arange(draws + 1), "a": total[:, 0], "b": total[:, 1], "n": total[:, 2]})

    per = sums.groupBy("chunk").applyInPandas(draw, "draw long, a double, b double, n double").groupBy("draw").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    rate = per.withColumn("delta", T.ratio(F.col("a"), F.col("n")) - T.ratio(F.col("b"), F.col("n")))
    real = F.col("draw") == draws
    return rate.agg(F.max(F.when(real, T.ratio(F.col("a"), F.col("n")))).alias("a_rate"), F.max(F.when(real, T.ratio(F.col("b"), F.col("n")))).alias("b_rate"), F.max(F.when(real, F.col("delta"))).alias("delta"), F.percentile(F.when(~real, F.col("delta")), F.lit(0.025)).alias("low"), F.percentile(F.when(~real, F.col("delta")), F.lit(0.975)).alias("high"))


def convolve(dist: DataFrame, times: int, above: int) -> DataFrame:
    """One row: the chance that the sum of `times` draws of (value, p) exceeds `above`; the table of values is small by nature."""
    out = dist.select("value", "p")
    for _ in range(times - 1):
        other = dist.select(F.col("value").alias("v"), F.col("p").alias("q"))
        out = out.crossJoin(F.broadcast(other)).groupBy((F.col("value") + F.col("v")).alias("value")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return out.agg(F.coalesce(F.sum(F.when(F.col("value") > above, F.col("p"))), F.lit(0.0)).alias("tail"))


def digit_rates(lines: DataFrame) -> DataFrame:
    digits = F.regexp_count("line", F.lit(r"[0-9]"))
    return lines.agg(F.count("*").alias("lines"), F.count_if(digits > 0).alias("lines_with_digit"), T.ratio(F.sum(digits) * 1000, F.sum(F.char_length("line"))).alias("digits_per_1000"))


