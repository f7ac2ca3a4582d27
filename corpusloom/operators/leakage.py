"""Overlap between a corpus and a protected one, decontamination, duplicates, near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions import text as T
from corpusloom.functions.udfs import compare_sets, nfc, part_signatures

#: A protected side of at most so many grams is broadcast; a larger one is shuffled.
BROADCAST_GRAMS = 1_000_000

#: From this similarity on a part of a set holds about five elements or more, and sets are compared by parts.
PARTS_PERCENT = 80

#: So many sets on each side of a task's comparisons; a place with more pairs is cut.
SQUARE = 256


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, line_no from 0, line): stripped lines, blank ones dropped."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(T.lines_stripped(F.coalesce(F.col(text_col), F.lit("")))).alias("line_no", "line"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_GRAMS else df


#: Kinds of grams beside the word n-grams, whose kind is their n.
LINE, CHARS = 0, -1

#: Lines are cut into pieces of so many characters, so that a character's place is found in few steps.
PIECE = 64


def grams(lines: DataFrame, ns: tuple[int, ...] = (), char_n: int = 0) -> DataFrame:
    """(kind, gram) of all lines with repeats: the lines themselves, word n-grams and runs of char_n characters.

    Rows are exploded by place and grams made one by one, in one pass and in generated code; no list of the grams of
    a line is made.  (The outer explodes keep Spark from splitting each line a second time to test for emptiness.)"""
    pieces = F.array("line")
    if char_n:
        pieces = F.concat(pieces, F.regexp_extract_all("line", F.lit(f"(?s)(?=(.{{{char_n},{PIECE + char_n - 1}}})).{{1,{PIECE}}}"), F.lit(1)))
    whole, at = F.col("piece") == 0, F.col("at")
    each = lines.where("line IS NOT NULL").select(F.posexplode_outer(pieces).alias("piece", "text"))
    each = each.select("piece", "text", F.when(whole, T.tokens(F.col("text"))).alias("w"))
    places = F.when(whole, F.greatest(F.size("w"), F.lit(1))).otherwise(F.char_length("text") - (char_n - 1))
    each = each.select("piece", "text", "w", F.explode_outer(F.sequence(F.lit(0), places - 1)).alias("at"))
    made = [(LINE, F.when(at == 0, F.col("text")))]
    made += [(n, F.when(at + n <= F.size("w"), F.concat_ws(" ", *[F.get("w", at + i) for i in range(n)]))) for n in ns]
    some = F.array(*[F.struct(F.lit(kind).alias("kind"), gram.alias("gram")) for kind, gram in made])
    if char_n:
        some = F.when(whole, some).otherwise(F.array(F.struct(F.lit(CHARS).alias("kind"), F.substring(F.col("text"), at + 1, F.lit(char_n)).alias("gram"))))
    return each.select(F.explode_outer(some).alias("e")).select("e.kind", "e.gram").where("gram IS NOT NULL")


def _seen(source: DataFrame, wanted: DataFrame, ns: tuple[int, ...], char_n: int = 0) -> DataFrame:
    """Distinct (kind, gram) of the source, those of `wanted` among them and hardly others: by a hash, which is looked up
    much faster than a text.  What is counted in the end is joined by the texts again."""
    h = F.xxhash64("kind", "gram").alias("h")
    return grams(source, ns, char_n).select("kind", "gram", h).join(_small(wanted.select(h)), "h", "left_semi").select("kind", "gram").distinct()


def directed_overlap(source: DataFrame, target: DataFrame, ns: tuple[int, ...] = (1, 2, 3), char_n: int = 5) -> DataFrame:
    """(measure, total, seen, share): share of target types and tokens that the source has; denominators of at least 1.

    All grams of a line come from one split of it; the source's are cut down to those of the target (broadcast where
    its size allows) before anything is made distinct."""
    counts = grams(target, ns, char_n).groupBy("kind", "gram").agg(F.count("*").alias("n"))
    seen = _seen(source, counts, ns, char_n).withColumn("known", F.lit(1))
    both = counts.join(seen, ["kind", "gram"], "left")
    sums = both.groupBy("kind").agg(F.count("*").alias("types"), F.count("known").alias("types_seen"), F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("tokens_seen"))
    measures = [("lines", LINE, "types")] + [(f"word{n}_{t}", n, t) for n in ns for t in ("types", "tokens")] + [(f"char{char_n}_types", CHARS, "types")]
    wanted = F.broadcast(source.sparkSession.createDataFrame(measures, "measure string, kind int, of string")).join(sums, "kind", "left")
    pick = lambda a, b: F.coalesce(F.when(F.col("of") == "types", F.col(a)).otherwise(F.col(b)), F.lit(0))
    out = wanted.select("measure", pick("types", "tokens").alias("total"), pick("types_seen", "tokens_seen").alias("seen"))
    return out.withColumn("share", F.col("seen") / F.greatest(F.col("total"), F.lit(1)))


def gram_overlap(source: DataFrame, target: DataFrame, n: int = 3, normal: bool = False, per_line: bool = False) -> DataFrame:
    """One row: target_grams, shared_grams, share, shared_lines.

    `per_line` counts each target line that the source has; otherwise distinct ones.  `normal` compares normal forms.
    The source is read once; its grams and lines are cut down to the target's before they are made distinct."""
    if normal:
        source, target = (d.select(nfc(F.col("line")).alias("line")) for d in (source, target))
    counts = grams(target, (n,)).groupBy("kind", "gram").agg(F.count("*").alias("k"))
    both = counts.join(_seen(source, counts, (n,)).withColumn("known", F.lit(1)), ["kind", "gram"], "left")
    known = F.col("known") == 1
    lines = F.coalesce(F.sum(F.when(known & (F.col("kind") == LINE), F.col("k"))), F.lit(0)) if per_line else F.count_if(known & (F.col("kind") == LINE))
    one = both.agg(F.count_if(F.col("kind") == n).alias("target_grams"), F.count_if(known & (F.col("kind") == n)).alias("shared_grams"), lines.alias("shared_lines"))
    return one.select("target_grams", "shared_grams", T.ratio(F.col("shared_grams"), F.col("target_grams")).alias("share"), "shared_lines")


def _kinds(lines: DataFrame, n: int) -> DataFrame:
    """(kind, text) of normal-form lines and word n-grams with repeats; blank lines are dropped."""
    each = grams(lines.select(nfc(F.col("line")).alias("line")).where(F.trim("line") != ""), (n,))
    return each.select(F.when(F.col("kind") == LINE, "line").otherwise(f"word{n}").alias("kind"), F.col("gram").alias("text"))


def hash_fixture(lines: DataFrame, n: int = 3) -> DataFrame:
    """(kind, sha256) of distinct normal-form lines and word n-grams; blank lines are dropped.  The text itself stays home."""
    return _kinds(lines, n).distinct().select("kind", T.sha256(F.col("text")).alias("sha256"))


def hashed_overlap(lines: DataFrame, fixture: DataFrame, n: int = 3) -> DataFrame:
    """(kind, total, shared) of a corpus against a hash-only fixture.

    Where the fixture can be broadcast, each text is hashed and looked up where it stands; 94 bits of two hashes travel in
    its place, with kind and hit in two more.  For a larger fixture the distinct texts travel."""
    known = fixture.select("kind", "sha256").distinct()
    if known.count() > BROADCAST_GRAMS:
        return hash_fixture(lines, n).join(known.withColumn("hit", F.lit(1)), ["kind", "sha256"], "left").groupBy("kind").agg(F.count("*").alias("total"), F.count("hit").alias("shared"))
    looked = _kinds(lines, n).withColumn("sha256", T.sha256(F.col("text"))).join(F.broadcast(known.withColumn("hit", F.lit(1))), ["kind", "sha256"], "left")
    mark = F.when(F.col("kind") == "line", 2).otherwise(0) + F.coalesce("hit", F.lit(0))
    low = F.hash("text").bitwiseAND(F.lit(-4)).bitwiseOR(mark)
    keys = looked.select(F.xxhash64("text").alias("high"), low.alias("low")).distinct()
    marks = keys.groupBy(F.col("low").bitwiseAND(F.lit(3)).alias("mark")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("mark") >= 2, "line").otherwise(f"word{n}").alias("kind")
    return marks.groupBy(kind).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("mark") % 2 == 1, F.col("n"))), F.lit(0)).alias("shared"))


def letter_words(text: Column) -> Column:
    """Words of letters only, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def pool_hits(lines: DataFrame, pools: list[tuple[str, DataFrame]], n: int = 6) -> DataFrame:
    """(id, line_no, pool): lines with a letters-only n-gram of a pool; the first pool in order gets the hit."""
    grams_of = F.explode(F.array_distinct(T.word_ngrams(F.col("w"), n))).alias("gram")
    rows = lines.select("id", "line_no", letter_words(F.col("line")).alias("w")).select("id", "line_no", grams_of)
    known = None
    for rank, (name, pool) in enumerate(pools):
        own = pool.select(letter_words(F.col("line")).alias("w")).select(grams_of).distinct().select("gram", F.lit(rank).alias("rank"), F.lit(name).alias("pool"))
        known = own if known is None else known.unionByName(own)
    best = known.groupBy("gram").agg(F.min(F.struct("rank", "pool")).alias("best"))
    return rows.join(_small(best), "gram").groupBy("id", "line_no").agg(F.min("best").alias("best")).select("id", "line_no", F.col("best.pool").alias("pool"))


def decontaminated(lines: DataFrame, pools: list[tuple[str, DataFrame]], n: int = 6) -> DataFrame:
    """Lines without a hit in any pool."""
    return lines.join(pool_hits(lines, pools, n), ["id", "line_no"], "left_anti")


def control_hits(control: DataFrame, pools: list[tuple[str, DataFrame]], n: int = 6) -> DataFrame:
    """Positive control: (lines, hits, ok); every control line has to hit."""
    hits = pool_hits(control, pools, n)
    return control.agg(F.count("*").alias("lines")).crossJoin(hits.agg(F.count("*").alias("hits"))).withColumn("ok", (F.col("lines") > 0) & (F.col("lines") == F.col("hits")))


def skeleton_leak(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: distinct target skeletons, of them in the source, and target characters that the source never has."""
    skel = lambda d: d.select(T.skeleton(F.col("line")).alias("s")).distinct()
    chars = lambda d: d.select(F.explode(F.array_distinct(T.characters(F.col("line")))).alias("c")).distinct()
    own = skel(target)
    return own.agg(F.count("*").alias("skeletons")).crossJoin(own.join(skel(source), "s", "left_semi").agg(F.count("*").alias("shared_skeletons"))).crossJoin(chars(target).join(chars(source), "c", "left_anti").agg(F.count("*").alias("unseen_characters")))


def template_refill(lines: DataFrame, most: int = 25, distinct_share: float = 0.97) -> DataFrame:
    """One row: the largest count of one two-word opening, the share of distinct skeletons, and whether both limits hold."""
    top = lines.groupBy(F.substring_index("line", " ", 2).alias("opening")).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_opening"))
    share = lines.agg(F.count_distinct(T.skeleton(F.col("line"))).alias("skeletons"), F.count("*").alias("lines"))
    return top.crossJoin(share).select("max_opening", "skeletons", "lines", ((F.col("max_opening") <= most) & (T.ratio(F.col("skeletons"), F.col("lines")) >= distinct_share)).alias("ok"))


def duplicate_rows(docs: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """Rows with `seen_before`: the normal, space-collapsed text was seen earlier in the order.

    The earliest place of each text is an aggregate; only texts with several rows are joined back, broadcast where they
    are few, so a text with many copies is no hot task then."""
    norm = docs.withColumn("__h", F.sha2(F.array_join(T.tokens(nfc(F.coalesce(F.col(text_col), F.lit("")))), " "), 256))
    first = norm.groupBy("__h").agg(F.min(order_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return norm.join(_small(first), "__h", "left").withColumn("seen_before", F.coalesce(F.col(order_col) > F.col("__first"), F.lit(False))).drop("__h", "__first")


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    """(key, count) of values that occur more than once."""
    return rows.groupBy(key).count().where("count > 1")


def duplicate_rate(rows: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """One row: groups, extra rows, rows and the rate of extra rows."""
    sizes = rows.groupBy(key).count()
    return sizes.agg(F.count_if(F.col("count") > 1).alias("groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).withColumn("rate", T.ratio(F.col("extra"), F.col("rows"), digits))


def _by_rare_elements(rows: DataFrame, percent: float) -> DataFrame:
    """Candidates (ha, hb, place): of each set only its rarest elements are indexed, as many as a partner has to share one of.

    For low percentages only, whose sets have too few elements a part."""
    each = rows.select("id", "h", F.size("s").alias("n"), F.explode("s").alias("x"))
    shared = each.join(each.groupBy("x").agg(F.count("*").alias("df")).where("df > 1"), "x")
    own = Window.partitionBy("id", "h", "n")
    ones = F.col("n") - F.count("*").over(own)  # elements of one document only come first
    head = shared.withColumn("rank", F.row_number().over(own.orderBy("df", "x")) + ones).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    a, b = (head.select("x", *[F.col(c).alias(f"{c}{side}") for c in ("id", "h", "n")]) for side in "ab")
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    return a.join(b, "x").where((F.col("ida") < F.col("idb")) & near).select("ha", "hb", F.col("ha").alias("place")).distinct()


def _by_parts(rows: DataFrame, percent: float) -> DataFrame:
    """Candidates (ha, hb, place): sets that have the same elements in one of so many parts that a partner cannot differ
    in all.  They meet where their least common part is, so that many near copies of a text have few places."""
    each = rows.select("id", "h", F.explode(part_signatures(F.transform("s", lambda x: F.xxhash64(x)), percent)).alias("part"))
    a, b = (each.select("part", F.col("id").alias(f"id{side}"), F.col("h").alias(f"h{side}")) for side in "ab")
    return a.join(b, "part").where("ida < idb").groupBy("ha", "hb").agg(F.min("part").alias("place"))


def near_duplicate_pairs(docs: DataFrame, id_col: str, sets: Column, percent: float = 90) -> DataFrame:
    """(a, b, both, either) of documents whose sets have a Jaccard similarity of at least percent / 100.

    Equal sets fold to their least id first.  Each set gives about a tenth as many signatures as it has elements, twice,
    whatever the size of the corpus; each stands for about ten elements, so common elements alone make no candidates.
    Candidates name hashes only; a set travels once to each place where it is compared in full, not once a candidate.
    A place of many pairs is cut into squares of about `SQUARE` sets a side."""
    rows = docs.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(sets)).alias("s")).where((F.size("s") > 0) & F.col("id").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("s"))
    if rows.schema["s"].dataType == ArrayType(StringType(), rows.schema["s"].dataType.containsNull):
        text = F.array_join("s", "\n")  # half the size of an array; sets with nulls or line ends in their elements stay arrays
        rows = rows.withColumn("text", F.when(F.get("s", F.lit(0)).isNotNull() & (F.size(F.split(text, "\n")) == F.size("s")), text))
        rows = rows.select("id", "h", "text", F.when(F.col("text").isNull(), F.col("s")).alias("more")).repartition("h").groupBy("h", "text", "more").agg(F.min("id").alias("id"))
        rows = rows.select("id", "h", "text", "more", F.coalesce(F.split("text", "\n"), "more").alias("s"))
    else:
        rows = rows.repartition("h").groupBy("h", "s").agg(F.min("id").alias("id")).withColumns({"text": F.lit(None).cast("string"), "more": F.col("s")})
    cand = _by_parts(rows, percent) if percent >= PARTS_PERCENT else _by_rare_elements(rows, percent)
    large = cand.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > SQUARE * SQUARE).select("place", F.ceil(F.sqrt("n") / SQUARE).alias("k"))
    k = F.coalesce("k", F.lit(1))
    cand = cand.join(F.broadcast(large), "place", "left").select("place", F.pmod("ha", k).alias("i"), F.pmod("hb", k).alias("j"), "ha", "hb")
    at = ["place", "i", "j"]
    goes = cand.select(*at, F.explode(F.array("ha", "hb")).alias("h")).distinct()
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    sent = goes.join(rows, "h").select(*at, F.col("h").alias("ha"), F.lit(None).cast("long").alias("hb"), "id", "text", "more")
    both = sent.unionByName(cand.select(*at, "ha", "hb", *[none(c) for c in ("id", "text", "more")])).repartition(*at).sortWithinPartitions(*at, F.col("hb").asc_nulls_first())
    kind = rows.schema["id"].dataType.simpleString()
    return both.mapInArrow(compare_sets(percent), f"a {kind}, b {kind}, both int, either int")


def cross_corpus_lines(lines: DataFrame, corpus: str) -> DataFrame:
    """Lines that more than one corpus holds: (line, corpora)."""
    return lines.groupBy("line").agg(F.count_distinct(corpus).alias("corpora")).where("corpora > 1")


def multiset_difference(ref: DataFrame, hyp: DataFrame, key: list[str]) -> DataFrame:
    """(key, missed, extra, common) counts of two bags."""
    r, h = ref.groupBy(*key).agg(F.count("*").alias("r")), hyp.groupBy(*key).agg(F.count("*").alias("h"))
    both = r.join(h, key, "full_outer").fillna(0, ["r", "h"])
    return both.select(*key, F.greatest(F.col("r") - F.col("h"), F.lit(0)).alias("missed"), F.greatest(F.col("h") - F.col("r"), F.lit(0)).alias("extra"), F.least("r", "h").alias("common"))
