"""Generated batches: flattening, lookups, coverage, findings, reviews and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.geometry import boxes_overlap, segment_hits_box
from corpusloom.functions.text import ratio

# Ink bands, review vocabularies.
NEAR_BLANK, LOW_INK, HIGH_INK = 0.002, 0.01, 0.95
DECISIONS = ("pass", "hold", "reject")
SEVERITIES = ("P0", "P1", "P2", "info")
REASON_CODES = (
    "invalid_manifest", "unsafe_asset_path", "missing_asset", "hash_mismatch", "blank_or_near_blank_page", "hebrew_not_readable",
    "text_clipped", "text_overlap", "layout_implausible", "degradation_obscures_text", "metadata_image_mismatch", "catalog_join_problem",
    "excessive_repetition", "style_condition_not_distinct", "forbidden_claim_risk", "reviewer_uncertain",
)
REVIEW_FIELDS = (
    "batch_id", "sample_id", "page_id", "template_id", "recipe_id", "persona", "condition", "degradation", "font_id",
    "asset_path", "reviewer", "decision", "severity", "reason_codes", "notes", "regression_fixture_candidate",
)
_PAGE_KEY = ["batch_id", "sample_id", "page_id"]


def flatten_manifest(manifests: DataFrame, nulls: str | None = "default") -> DataFrame:
    """One row a page of manifests (batch_id, samples): sample fields, controls and page fields.

    `nulls` stands for empty controls ("default" for analysis, "" for review, None keeps null)."""
    s = manifests.select("batch_id", F.posexplode_outer("samples").alias("sample_pos", "s"))
    p = s.select("batch_id", "sample_pos", "s", F.posexplode_outer("s.pages").alias("page_pos", "p"))
    control = lambda c: F.col(c) if nulls is None else F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(nulls))
    prov = "s.provenance"
    return p.select(
        "batch_id", "sample_pos", "page_pos", F.col("s.sample_id").alias("sample_id"), F.col("p.page_id").alias("page_id"),
        F.col(f"{prov}.template_id").alias("template_id"), F.coalesce(f"{prov}.recipe_id", "s.recipe_id").alias("recipe_id"),
        control("s.controls.persona").alias("persona"), control("s.controls.condition").alias("condition"),
        F.col(f"{prov}.degradation_preset").alias("degradation"), F.col(f"{prov}.font_id").alias("font_id"),
        F.concat_ws("/", "batch_id", "p.asset_path").alias("asset_path"), F.col("p.sha256").alias("sha256"),
        F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.col("s.text.logical_order").alias("text"),
    )


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page of each sample."""
    return pages.groupBy("batch_id", "sample_id").agg(F.min_by(F.struct(*pages.columns), "page_pos").alias("p")).select("p.*")


def join_catalog(samples: DataFrame, catalog: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Samples with their catalog fields, and the key pairs that the catalog lacks."""
    return samples.join(catalog, keys, "left"), samples.select(*keys).distinct().join(catalog, keys, "left_anti")


def provenance_mismatches(samples: DataFrame, templates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, actual, expected) of columns that differ from the template's."""
    known = templates.select(key, F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = samples.join(known, key, "left")
    diffs = [F.when(F.col("__known").isNull(), F.struct(F.lit("template").alias("column"), F.col(key).cast("string").alias("actual"), F.lit(None).cast("string").alias("expected")))]
    diffs += [F.when(F.col("__known") & ~F.col(c).eqNullSafe(F.col(f"__{c}")), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("actual"), F.col(f"__{c}").cast("string").alias("expected"))) for c in columns]
    return both.select(key, F.explode(F.array_compact(F.array(*diffs))).alias("d")).select(key, "d.*")


def reconcile(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): both, missing or extra."""
    e, a = expected.select(*key).distinct().withColumn("__e", F.lit(1)), actual.select(*key).distinct().withColumn("__a", F.lit(1))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").otherwise("both")
    return e.join(a, key, "full_outer").select(*key, status.alias("status"))


def positional_mismatches(left: DataFrame, right: DataFrame, pos: str, keys: list[str]) -> DataFrame:
    """Places where two ordered lists differ in length or keys."""
    r = right.select(F.col(pos), F.lit(1).alias("__r"), *[F.col(k).alias(f"r_{k}") for k in keys])
    both = left.select(pos, F.lit(1).alias("__l"), *keys).join(r, pos, "full_outer")
    differs = F.col("__l").isNull() | F.col("__r").isNull()
    for k in keys:
        differs = differs | ~F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return both.where(differs).drop("__l", "__r")


def keyed_mismatches(declared: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """(key, problem): duplicate, unknown or missing keys of a sidecar."""
    d = declared.groupBy(*key).agg(F.count("*").alias("n"))
    both = d.join(known.select(*key).distinct().withColumn("__k", F.lit(1)), key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("__k").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(*key, "problem")


def attach_warnings(samples: DataFrame, warnings: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """Samples with the sorted distinct codes of their warnings."""
    own = warnings.groupBy(*keys).agg(F.array_sort(F.collect_set(code)).alias("warnings"))
    return samples.join(own, keys, "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key no parent has; null keys are orphans too."""
    return child.join(parent.select(F.col(parent_key or key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def member_owners(regions: DataFrame, page: list[str], region: str, members: str) -> DataFrame:
    """(page, line_index, owners) of lines that not exactly one region lists."""
    return regions.select(*page, region, F.explode(members).alias("line_index")).groupBy(*page, "line_index").agg(F.count("*").alias("owners")).where("owners <> 1")


def box_overlaps(a: DataFrame, b: DataFrame, page: list[str], box_a: str, box_b: str, cell: int = 256) -> DataFrame:
    """Pairs on one page whose boxes overlap strictly; boxes meet in grid cells, so a full page is not compared pair by pair."""

    def cells(d: DataFrame, box: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.get(box, F.lit(lo)) / cell), F.floor(F.get(box, F.lit(hi)) / cell)))
        return d.withColumn("__x", span(0, 2)).withColumn("__y", span(1, 3))

    low = lambda i: F.floor(F.greatest(F.get(box_a, F.lit(i)), F.get(box_b, F.lit(i))) / cell)
    both = cells(a, box_a).join(cells(b, box_b), [*page, "__x", "__y"])
    once = (F.col("__x") == low(0)) & (F.col("__y") == low(1))  # the cell of the common corner only
    return both.where(boxes_overlap(F.col(box_a), F.col(box_b)) & once).drop("__x", "__y")


def occluded(lines: DataFrame, marks: DataFrame, page: list[str], line: str, box: str, owner: str, p: str, q: str) -> DataFrame:
    """Lines that a mark's segment crosses, the mark's own line excepted."""
    m = marks.select(*page, F.col(owner).alias("__o"), F.col(p).alias("__p"), F.col(q).alias("__q"))
    hit = lines.join(m, page).where(~F.col(line).eqNullSafe(F.col("__o")) & segment_hits_box(F.col("__p"), F.col("__q"), F.col(box)))
    return hit.select(*page, line).distinct()


def exclude_works(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, default: str = "?") -> DataFrame:
    return rows.join(lookup.select(key, value), key, "left").fillna({value: default})


def renderable(lines: DataFrame, chars: DataFrame, line: str = "line") -> DataFrame:
    """Lines with `missing`: their distinct characters, spaces aside, that a set lacks."""
    have = chars.agg(F.collect_set("char").alias("__have"))
    own = F.array_distinct(F.filter(F.split(line, ""), lambda c: (c != "") & (c != " ")))
    return lines.crossJoin(F.broadcast(have)).withColumn("missing", F.array_sort(F.array_except(own, F.col("__have")))).drop("__have")


def admitted_fonts(fonts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Fonts that are flagged, licensed, hashed right and not on an exclusion list of families and hashes."""
    ok = fonts.where(F.col("redistributable") & F.col("licence_file").isNotNull() & (F.col("sha256") == F.col("actual_sha256")))
    fam = excluded.where("family IS NOT NULL").select(F.lower(F.translate("family", " -_", "")).alias("__f"))
    sha = excluded.where("sha256 IS NOT NULL").select(F.col("sha256").alias("__s"))
    return ok.join(fam, F.lower(F.translate("family", " -_", "")) == F.col("__f"), "left_anti").join(sha, F.col("sha256") == F.col("__s"), "left_anti")


def in_band(value: Column, target: Column, tolerance: float = 0.12) -> Column:
    return F.coalesce(F.abs(F.try_divide(value, target) - 1) <= tolerance, F.lit(False))


def ink_band(density: Column) -> Column:
    return F.when(density <= NEAR_BLANK, "near_blank_image").when(density < LOW_INK, "low_ink_density").when(density > HIGH_INK, "high_ink_density")


# ---- coverage and roll-ups ----


def missing_values(observed: DataFrame, requested: DataFrame) -> DataFrame:
    """(dimension, missing, complete): requested (dimension, value) that were not observed."""
    left = requested.join(observed.select("dimension", "value").distinct().withColumn("__o", F.lit(1)), ["dimension", "value"], "left")
    return left.groupBy("dimension").agg(F.array_sort(F.collect_set(F.when(F.col("__o").isNull(), F.col("value")))).alias("missing")).withColumn("complete", F.size("missing") == 0)


def dimension_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.concat_ws("x", "width", "height").alias("dimensions")).agg(F.count("*").alias("n"))


def status(findings: DataFrame) -> DataFrame:
    """One row: blocked by any P0, passed_with_warnings by any other, else passed."""
    blocked, warned = F.count_if(F.col("severity") == "P0"), F.count("*")
    return findings.agg(F.when(blocked > 0, "blocked").when(warned > 0, "passed_with_warnings").otherwise("passed").alias("status"))


def quality_rollup(pages: DataFrame, by: str, sums: list[str], limits: dict[str, float]) -> DataFrame:
    """Sums for each value of `by` and in total (null), and `over`: measures whose rate a page is strictly above its limit."""
    total = pages.rollup(by).agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in sums])
    over = F.array_compact(F.array(*[F.when(F.col(c) / F.col("pages") > limit, F.lit(c)) for c, limit in limits.items()]))
    return total.withColumn("over", over)


def coverage_entries(features: DataFrame, expected: list[tuple[str, list[str]]]) -> DataFrame:
    """(dimension, covered, missing) of (dimension, value, sample_id) rows; both lists in the expected order."""
    spark = features.sparkSession
    want = spark.createDataFrame([(d, v, i) for d, vs in expected for i, v in enumerate(vs)], "dimension string, value string, rank int")
    seen = features.groupBy("dimension", "value").agg(F.count_distinct("sample_id").alias("samples"))
    both = F.broadcast(want).join(seen, ["dimension", "value"], "left")
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "value")))), lambda x: x["value"])
    return both.groupBy("dimension").agg(ordered(F.col("samples").isNotNull()).alias("covered"), ordered(F.col("samples").isNull()).alias("missing"))


def limitations(coverage: DataFrame) -> DataFrame:
    return coverage.where(F.size("missing") > 0).select("dimension", F.concat(F.lit("not covered: "), F.array_join("missing", ", ")).alias("limitation"))


def holds_for_all(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: whether a condition holds for every row; false without rows."""
    return rows.agg((F.coalesce(F.bool_and(condition), F.lit(False)) & (F.count("*") > 0)).alias("holds"))


def review_counts(reviews: DataFrame) -> DataFrame:
    """(field, value, n) of decisions, severities and reason codes, zero where a value does not occur."""
    spark = reviews.sparkSession
    domain = spark.createDataFrame([(f, v) for f, vs in (("decision", DECISIONS), ("severity", SEVERITIES), ("reason_code", REASON_CODES)) for v in vs], "field string, value string")
    parts = [reviews.select(F.lit("decision").alias("field"), F.col("decision").alias("value")), reviews.select(F.lit("severity"), "severity"), reviews.select(F.lit("reason_code"), F.explode("reason_codes"))]
    found = parts[0].union(parts[1]).union(parts[2]).groupBy("field", "value").agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(found, ["field", "value"], "left").fillna(0, ["n"])


def validate_reviews(reviews: DataFrame, pages: DataFrame) -> DataFrame:
    """(code, batch_id, sample_id, page_id, line): every rule that a worksheet breaks.

    reviews: key, line, reviewer, decision, severity, reason_codes, regression_fixture_candidate; pages: key."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    first = reviews.groupBy(*_PAGE_KEY).agg(F.min("line").alias("__first"))
    known = pages.select(*_PAGE_KEY).distinct().withColumn("__known", F.lit(True))
    rows = reviews.join(first, _PAGE_KEY, "left").join(known, _PAGE_KEY, "left")
    adverse = F.col("decision").isin("hold", "reject")
    rules = {
        "unknown_page_id": F.col("__known").isNull(),
        "duplicate_page_row": F.col("line") > F.col("__first"),
        "unknown_decision": ~blank("decision") & ~F.col("decision").isin(*DECISIONS),
        "missing_reviewer": ~blank("decision") & blank("reviewer"),
        "reviewer_without_decision": blank("decision") & ~blank("reviewer"),
        "unknown_severity": ~blank("severity") & ~F.col("severity").isin(*SEVERITIES),
        "unknown_reason_code": F.exists("reason_codes", lambda r: ~r.isin(*REASON_CODES)),
        "invalid_regression_fixture_value": ~blank("regression_fixture_candidate") & ~F.lower("regression_fixture_candidate").isin("true", "false", "yes", "no"),
        "missing_severity": adverse & blank("severity"),
        "missing_reason_codes": adverse & (F.coalesce(F.size("reason_codes"), F.lit(0)) == 0),
    }
    broken = rows.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("code"), *_PAGE_KEY, "line")
    absent = pages.select(*_PAGE_KEY).distinct().join(reviews.select(*_PAGE_KEY), _PAGE_KEY, "left_anti").select(F.lit("missing_page_row").alias("code"), *_PAGE_KEY, F.lit(None).cast("long").alias("line"))
    return broken.unionByName(absent)


# Finding codes by severity.
FINDING_SEVERITY = {
    "P0": ["wet_run_not_passed", "wet_run_report_invalid", "wet_run_batch_path_invalid", "wet_run_path_invalid", "batch_validation_failed", "manifest_missing", "manifest_json_invalid", "manifest_samples_invalid", "manifest_sample_invalid", "manifest_pages_invalid", "manifest_page_invalid", "unsafe_asset_path", "asset_unreadable", "page_dimension_metadata_invalid", "manifest_hash_mismatch", "checksum_inventory_mismatch", "checksum_inventory_missing_asset", "checksum_inventory_missing_expected_artifact", "checksum_inventory_missing", "checksum_inventory_malformed", "checksum_inventory_unsafe_path", "checksum_inventory_duplicate_path"],
    "P1": ["repeated_sample_id", "repeated_page_id", "near_blank_image", "catalog_join_missing"],
    "P2": ["duplicate_text", "repeated_page_hash", "low_ink_density", "high_ink_density", "checksum_inventory_extra_artifact"],
}


def severity_of(code: Column) -> Column:
    out = F.when(code.isin(*FINDING_SEVERITY["P0"]), "P0")
    return out.when(code.isin(*FINDING_SEVERITY["P1"]), "P1").when(code.isin(*FINDING_SEVERITY["P2"]), "P2")


def page_findings(pages: DataFrame, inventory: DataFrame, catalog: DataFrame) -> DataFrame:
    """(code, severity, source_path, n): findings of flattened pages.

    pages: flatten_manifest columns with actual_sha256, actual_width, actual_height, ink_density (null: unreadable);
    inventory: path, digest; catalog: template_id, recipe_id."""
    unsafe = ~safe_path(F.col("asset_path"))
    inv = inventory.select(F.col("path").alias("asset_path"), F.col("digest").alias("__d"))
    cat = catalog.select("template_id", "recipe_id", F.lit(1).alias("__c")).distinct()
    rows = pages.join(inv, "asset_path", "left").join(F.broadcast(cat), ["template_id", "recipe_id"], "left")
    rules = [
        F.when(unsafe, "unsafe_asset_path"),
        F.when(F.col("actual_sha256").isNull(), "asset_unreadable"),
        F.when(F.col("width").isNull() | F.col("height").isNull() | (F.col("width") < 1) | (F.col("height") < 1), "page_dimension_metadata_invalid"),
        F.when(F.col("actual_sha256") != F.col("sha256"), "manifest_hash_mismatch"),
        F.when(F.col("__d").isNull(), "checksum_inventory_missing_asset"),
        F.when(F.col("__d") != F.col("actual_sha256"), "checksum_inventory_mismatch"),
        ink_band(F.col("ink_density")),
        F.when(F.col("__c").isNull(), "catalog_join_missing"),
    ]
    own = rows.select(F.explode(F.array_compact(F.array(*rules))).alias("code"), F.col("asset_path").alias("source_path"), F.lit(1).cast("long").alias("n"))
    repeats = []
    for code, cols in (("repeated_sample_id", ["sample_id"]), ("repeated_page_id", ["page_id"]), ("repeated_page_hash", ["actual_sha256"]), ("duplicate_text", ["text"])):
        unit = pages.select("batch_id", "sample_pos", *cols).distinct() if code in ("repeated_sample_id", "duplicate_text") else pages.select(*cols)
        groups = unit.where(F.col(cols[0]).isNotNull()).groupBy(*cols).agg(F.count("*").alias("k")).where("k > 1")
        repeats.append(groups.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(code).alias("code"), F.lit(None).cast("string").alias("source_path"), "n"))
    extra = inventory.select(F.col("path").alias("source_path")).join(pages.select(F.col("asset_path").alias("source_path")), "source_path", "left_anti").select(F.lit("checksum_inventory_extra_artifact").alias("code"), "source_path", F.lit(1).cast("long").alias("n"))
    out = own.unionByName(extra)
    for r in repeats:
        out = out.unionByName(r)
    return out.withColumn("severity", severity_of(F.col("code"))).select("code", "severity", "source_path", "n")


# ---- paths: five rules that differ ----


def safe_path(p: Column) -> Column:
    """Relative, no parent steps, no backslash."""
    return p.isNotNull() & (p != "") & ~p.startswith("/") & ~p.contains("\\") & ~F.array_contains(F.split(p, "/"), "..")


def bank_path(p: Column) -> Column:
    """As safe_path, and no drive letters."""
    return safe_path(p) & ~p.rlike("^[A-Za-z]:")


def ascii_path(p: Column) -> Column:
    """As safe_path, and only letters, digits, dots, hyphens, underscores and slashes."""
    return safe_path(p) & p.rlike("^[A-Za-z0-9._/-]+$")


def canonical_path(p: Column) -> Column:
    """As safe_path, and no empty or single-dot steps."""
    return safe_path(p) & ~F.exists(F.split(p, "/"), lambda s: s.isin("", "."))


def inside(p: Column, root: str) -> Column:
    """Below a root, by text."""
    return canonical_path(p) & p.startswith(root.rstrip("/") + "/")


# ---- reports ----


def analysis_report(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: readable pages, samples, duplicate rate, ink range, findings by severity and status."""
    a = pages.agg(F.count_if(F.col("actual_sha256").isNotNull()).alias("page_count"), F.count_distinct("batch_id", "sample_pos").alias("sample_count"), F.min("ink_density").alias("ink_min"), F.max("ink_density").alias("ink_max"))
    texts = pages.where("text IS NOT NULL").select("batch_id", "sample_pos", "text").distinct().groupBy("text").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_samples"))
    f = findings.agg(*[F.count_if(F.col("severity") == s).alias(f"findings_{s.lower()}") for s in ("P0", "P1", "P2")])
    return a.crossJoin(texts).crossJoin(f).crossJoin(status(findings)).withColumn("duplicate_rate", ratio(F.col("duplicate_samples"), F.col("sample_count"), 6))


def aggregate_report(analysis: DataFrame, review: DataFrame | None, triage: DataFrame | None) -> DataFrame:
    """The analysis with the review's and the triage's status, not_provided where there is none."""
    out = analysis
    for name, part in (("review", review), ("triage", triage)):
        out = out.crossJoin(part.agg(F.max("status").alias(f"{name}_status"))) if part is not None else out.withColumn(f"{name}_status", F.lit("not_provided"))
    return out.withColumn("hard_blockers", F.col("status") == "blocked")


def triage_packet(pages: DataFrame, warnings: DataFrame, max_samples: int) -> DataFrame:
    """The first samples in order, one page each, with their warnings; the limit is the packet's own."""
    one = first_pages(pages)
    return attach_warnings(one, warnings, ["batch_id", "sample_id"]).orderBy("batch_id", "sample_id", "page_id").limit(max_samples)


def review_template(pages: DataFrame) -> DataFrame:
    """One empty review row a page, in worksheet order."""
    have = set(pages.columns)
    return pages.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in REVIEW_FIELDS])
