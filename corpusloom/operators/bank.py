"""Glyph banks: integrity, bands, weights, provenance, plans; and rule sets over manifests and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.geometry import polygon_contains
from corpusloom.functions.udfs import is_nfc
from corpusloom.operators.batch import bank_path, safe_path


def rules_frame(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule that a row breaks; a rule is a column that is true where it is broken."""
    return rows.select(*key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))


def bank_violations(styles: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(kind, id, rule): unique ids, references, licences, ordered triples, boxes inside sizes, single characters, scores, counts."""
    ordered = lambda c: (F.get(c, F.lit(0)) > F.get(c, F.lit(1))) | (F.get(c, F.lit(1)) > F.get(c, F.lit(2)))
    at = lambda c, i: F.get(c, F.lit(i))
    s = styles.groupBy("style_id").agg(F.count("*").alias("n"), F.first("licence").alias("licence"), F.first("attribution").alias("attribution"), F.first("letter_gap_px").alias("letter_gap_px"), F.first("word_gap_px").alias("word_gap_px"), F.first("glyph_count").alias("glyph_count"))
    actual = glyphs.groupBy("style_id").agg(F.count("*").alias("actual"))
    s = s.join(actual, "style_id", "left").fillna(0, ["actual"])
    style_rules = {
        "duplicate_style": F.col("n") > 1,
        "licence": F.coalesce(F.trim("licence"), F.lit("")) == "",
        "attribution": F.col("licence").startswith("CC-BY") & F.col("attribution").isNull(),
        "letter_gap_order": ordered("letter_gap_px"),
        "word_gap_order": ordered("word_gap_px"),
        "glyph_count": F.col("glyph_count") != F.col("actual"),
    }
    known = styles.select("style_id", F.lit(1).alias("__k")).distinct()
    dup = glyphs.groupBy("glyph_id").agg(F.count("*").alias("__n"))
    g = glyphs.join(known, "style_id", "left").join(dup, "glyph_id", "left")
    glyph_rules = {
        "duplicate_glyph": F.col("__n") > 1,
        "unknown_style": F.col("__k").isNull(),
        "character": F.char_length("char") != 1,
        "asset_path": ~bank_path(F.col("asset_path")),
        "mask_path": ~bank_path(F.col("mask_path")),
        "ink_box": (at("ink_box", 0) < 0) | (at("ink_box", 1) < 0) | (at("ink_box", 2) > at("size", 0)) | (at("ink_box", 3) > at("size", 1)) | (at("ink_box", 0) >= at("ink_box", 2)) | (at("ink_box", 1) >= at("ink_box", 3)),
        "score": F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1),
    }
    a = rules_frame(s, ["style_id"], style_rules).select(F.lit("style").alias("kind"), F.col("style_id").alias("id"), "rule")
    return a.unionByName(rules_frame(g, ["glyph_id"], glyph_rules).select(F.lit("glyph").alias("kind"), F.col("glyph_id").alias("id"), "rule"))


def count_mismatches(declared: DataFrame, rows: DataFrame, key: list[str], declared_n: str) -> DataFrame:
    """(key, declared, actual) of keys whose declared count is not the actual one."""
    actual = rows.groupBy(*key).agg(F.count("*").alias("actual"))
    both = declared.select(*key, F.col(declared_n).alias("declared")).join(actual, key, "full_outer").fillna(0, ["declared", "actual"])
    return both.where("declared <> actual")


def drop_outliers(rows: DataFrame, by: list[str], value: str, least: int = 6, low: float = 0.6, high: float = 1.6) -> DataFrame:
    """Rows whose value is within [low, high] of their group's median; groups under `least` rows stay whole."""
    mid = rows.groupBy(*by).agg(F.median(value).alias("__m"), F.count("*").alias("__n"))
    r = F.try_divide(F.col(value), F.col("__m"))
    return rows.join(mid, by).where((F.col("__n") < least) | F.coalesce(r.between(low, high), F.lit(True))).drop("__m", "__n")


def weight_band(rows: DataFrame, by: list[str], value: str, tolerance: float = 0.12, least: float = 0.8, most: float = 1.25) -> DataFrame:
    """Rows within a band around the overall median norm, scaled by a clamped factor of their group."""
    norm = rows.agg(F.median(value).alias("__norm"))
    group = rows.groupBy(*by).agg(F.median(value).alias("__g"))
    joined = rows.join(group, by).crossJoin(F.broadcast(norm))
    factor = F.greatest(F.lit(least), F.least(F.lit(most), F.try_divide(F.col("__g"), F.col("__norm"))))
    return joined.withColumn("factor", factor).where(F.abs(F.col(value) / (F.col("__norm") * F.col("factor")) - 1) <= tolerance).drop("__g", "__norm")


def heading_band(glyphs: DataFrame, x_height: str, above: float, least: int = 60) -> DataFrame:
    """One row: the median of large x-heights and their number, if there are at least `least`."""
    return glyphs.where(F.col(x_height) > above).agg(F.count("*").alias("n"), F.median(x_height).alias("target")).where(F.col("n") >= least)


def style_weights(glyphs: DataFrame, style: str = "style_id") -> DataFrame:
    """(style, n, weight): counts capped at three times the median count."""
    n = glyphs.groupBy(style).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg((3 * F.median("n")).alias("__cap")))).withColumn("weight", F.least(F.col("n").cast("double"), F.col("__cap"))).drop("__cap")


def missing_characters(lines: DataFrame, k: int = 8) -> DataFrame:
    """The k characters most often missing (column `missing`), ties by first line."""
    each = lines.select("line_no", F.posexplode("missing").alias("pos", "char"))
    return each.groupBy("char").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def page_provenance(placed: DataFrame, page: list[str]) -> DataFrame:
    """(page, glyph_count, unique_glyph_count, doubled, source_pages) of placed glyphs."""
    src = placed.groupBy(*page, "source_page").agg(F.count("*").alias("n")).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col("source_page").alias("page_id"), F.col("n").alias("glyph_count")))).alias("source_pages"))
    own = placed.groupBy(*page).agg(F.count("*").alias("glyph_count"), F.count_distinct("glyph_id").alias("unique_glyph_count"), F.expr("count_if(synthesized) div 2").alias("doubled"))
    return own.join(src, page)


def style_use(declared: DataFrame, placed: DataFrame) -> DataFrame:
    """(style_id, problem): listed but unused, used but unlisted."""
    a, b = declared.select("style_id").distinct(), placed.select("style_id").distinct()
    return a.join(b, "style_id", "left_anti").withColumn("problem", F.lit("unused")).unionByName(b.join(a, "style_id", "left_anti").withColumn("problem", F.lit("unlisted")))


def composition_totals(placed: DataFrame, by: str = "style_id") -> DataFrame:
    return placed.groupBy(by).agg(F.count("*").alias("glyphs"), F.count_distinct("page_id").alias("pages"), F.count_distinct("glyph_id").alias("distinct_glyphs"))


def realised_mix(rows: DataFrame, kind: str, target: dict[str, float]) -> DataFrame:
    """(kind, n, share, target, delta) of a realised mix against a wanted one, absent kinds included."""
    spark = rows.sparkSession
    want = spark.createDataFrame([(k, float(v)) for k, v in target.items()], "kind string, target double")
    n = rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    both = F.broadcast(want).join(n, "kind", "left").fillna(0, ["n"]).crossJoin(rows.agg(F.count("*").alias("total")))
    return both.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0))).withColumn("delta", F.col("share") - F.col("target")).drop("total")


def line_gold_mismatches(texts: DataFrame, placed: DataFrame, key: list[str], text: str, char: str) -> DataFrame:
    """(key, i, expected, actual) of characters that differ from the placed ones."""
    want = texts.select(*key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("i", "expected"))
    have = placed.select(*key, "i", F.col(char).alias("actual"))
    return want.join(have, [*key, "i"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


# ---- manifests and annotations ----


def manifest_violations(pages: DataFrame, constants: dict[str, str]) -> DataFrame:
    """(batch_id, sample_id, page_id, rule) of flattened pages with sample and text fields."""
    rules = {f"constant_{c}": ~F.col(c).eqNullSafe(F.lit(v)) for c, v in constants.items()}
    rules |= {
        "recipe": ~F.col("recipe_id").eqNullSafe(F.col("provenance_recipe_id")),
        "text_empty": F.coalesce(F.trim("text"), F.lit("")) == "",
        "text_normal_form": ~F.coalesce(is_nfc(F.col("text")), F.lit(False)),
        "path": ~safe_path(F.col("asset_path")),
        "sha256": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "dimensions": F.coalesce((F.col("width") < 1) | (F.col("height") < 1), F.lit(True)),
        "sample_id": ~F.coalesce(F.col("sample_id").rlike("^.+-s[0-9]{8}-[0-9]{6}$"), F.lit(False)),
    }
    return rules_frame(pages, ["batch_id", "sample_id", "page_id"], rules)


def closed_schema_extras(rows: DataFrame, json: str, allowed: list[str]) -> Column:
    """Keys of a JSON object that a closed schema does not name."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


def line_violations(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, line_index, rule) of annotated lines with width and height of their page."""
    w = Window.partitionBy(*page).orderBy("line_index")
    marked = lines.withColumn("__p", F.row_number().over(w) - 1).withColumn("__seen", F.max("logical_line_index").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__prev", F.lag("logical_line_index").over(w))
    x = lambda p: F.get(p, F.lit(0))
    y = lambda p: F.get(p, F.lit(1))
    in_page = lambda ps: F.forall(ps, lambda p: (x(p) >= 0) & (y(p) >= 0) & (x(p) <= F.col("width")) & (y(p) <= F.col("height")))
    first = ~F.col("logical_line_index").eqNullSafe(F.col("__prev"))
    rules = {
        "position": F.col("line_index") != F.col("__p"),
        "monotone": F.col("logical_line_index") < F.col("__seen"),
        "join_first": first & F.col("logical_join").isNotNull(),
        "join_missing": ~first & F.col("logical_line_index").isNotNull() & ~F.coalesce(F.col("logical_join").isin("space", "cell"), F.lit(False)),
        "normal_form": ~is_nfc(F.col("text")),
        "trim": F.col("text") != F.trim("text"),
        "empty": F.col("text") == "",
        "control_character": F.col("text").rlike(r"[\p{Cc}‎‏‪-‮⁦-⁩]"),
        "baseline_direction": x(F.get("baseline", F.lit(0))) >= x(F.element_at("baseline", -1)),
        "out_of_page": ~in_page(F.col("polygon")) | ~in_page(F.col("baseline")),
    }
    return rules_frame(marked, [*page, "line_index"], rules)


def region_violations(regions: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, region_index, rule) of region annotations against their lines."""
    w = Window.partitionBy(*page).orderBy("region_index")
    marked = regions.withColumn("__p", F.row_number().over(w) - 1)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("line_indices") - 1, F.lit(1))), lambda i: (F.size("line_indices") < 2) | (F.get("line_indices", i) > F.get("line_indices", i - 1)))
    own = rules_frame(marked, [*page, "region_index"], {"position": F.col("region_index") != F.col("__p"), "members_rising": ~rising, "no_members": F.size("line_indices") == 0})
    member = regions.select(*page, F.col("region_index").alias("__r"), F.col("type").alias("__t"), F.col("polygon").alias("__outer"), F.explode("line_indices").alias("line_index"))
    both = member.join(lines.select(*page, "line_index", "region", F.col("polygon").alias("__inner")), [*page, "line_index"], "left")
    owners = both.groupBy(*page, "line_index").agg(F.count("*").alias("__owners"))
    both = both.join(owners, [*page, "line_index"]).withColumnRenamed("__r", "region_index")
    rules = {
        "unknown_line": F.col("__inner").isNull(),
        "several_owners": F.col("__owners") > 1,
        "type": F.col("region") != F.col("__t"),
        "containment": ~polygon_contains(F.col("__outer"), F.col("__inner")),
    }
    return own.unionByName(rules_frame(both, [*page, "region_index"], rules).distinct())


def pair_violations(pairs: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(sample_id, page_id, rule) of paired renders: numbers that are not finite or out of range, paths, repeated assets."""
    dup = pairs.groupBy("asset_path").agg(F.count("*").alias("__n"))
    rows = pairs.join(dup, "asset_path", "left")
    rules = {"path": ~safe_path(F.col("asset_path")), "asset_twice": F.col("__n") > 1}
    for c, (a, b) in ranges.items():
        v = F.col(c).cast("double")
        rules[f"range_{c}"] = F.coalesce(F.isnan(v) | (v < a) | (v > b), F.lit(True))
    return rules_frame(rows, ["sample_id", "page_id"], rules)


def id_violations(rows: DataFrame, key: str, pattern: str = "^[A-Za-z0-9._-]+$") -> DataFrame:
    """(key, rule): unsafe or repeated ids."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return rules_frame(n, [key], {"unsafe_id": ~F.coalesce(F.col(key).rlike(pattern), F.lit(False)), "duplicate_id": F.col("n") > 1})


def packet_violations(packets: DataFrame, key: str, required: list[str], conditional: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, rule): required fields without a value, and fields that another field's value requires."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rules = {f"missing_{c}": blank(c) for c in required}
    rules |= {f"missing_{c}_when_{f}_{v}": (F.col(f) == v) & blank(c) for c, (f, v) in conditional.items()}
    return rules_frame(packets, [key], rules)


def unstable_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose hash changed or that came or went between two readings."""
    b = after.select("path", F.col("sha256").alias("__after"))
    return before.join(b, "path", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("__after"))).select("path")
