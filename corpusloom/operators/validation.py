"""Batches checked as one call: files, JSON, closed schemas, run reports and checksum inventories as rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.batch import safe_path, severity_of

_FAULT = "array<struct<location: string, keyword: string>>"
#: Schema versions of reports, and the path of the inventory and the report in a run.
VALIDATION_REPORT, GENERATION_REPORT, CATALOG, RICH_CATALOG, EVIDENCE = "validation_report.v1", "generation_report.v1", "template_catalog.v1", "template_catalog.v2", "candidate_evidence_run_report.v1"
INVENTORY_PATH, RUN_PATH = "reports/wet_test_checksums.txt", "reports/wet_test_run.json"


# ---- closed schemas ----


def _kinds(v: Column) -> dict[str, Column]:
    """JSON types of a VARIANT; a number without a fraction is an integer."""
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    real = F.try_variant_get(v, "$", "double")
    return {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN",
        "null": kind == "VOID", "number": number, "integer": number & F.coalesce(real == F.floor(real), F.lit(False)),
    }


def _step(key: str) -> str:
    return '["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def schema_faults(value: Column, schema: dict, at: Column | None = None, root: dict | None = None) -> Column:
    """The faults of a VARIANT under a JSON schema: array of (location, keyword), empty where it holds.

    The schema is compiled to one expression, which stays in the JVM.  Known keywords: type, const, enum, pattern,
    required, properties, additionalProperties false, items, prefixItems, minItems, maxItems, uniqueItems, minLength,
    maxLength, minimum, maximum, exclusiveMinimum, anyOf and $ref; another one raises.  Patterns search, as the
    keyword does.  A null value (no JSON) has the fault `type`."""
    at, root = F.lit("$") if at is None else at, root or schema
    known = {"type", "const", "enum", "pattern", "required", "properties", "additionalProperties", "items", "prefixItems", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "anyOf", "$ref"}
    noise = {"$schema", "$id", "$defs", "title", "description", "examples", "default", "$comment"}
    if set(schema) - known - noise:
        raise ValueError(f"unknown schema keywords: {sorted(set(schema) - known - noise)}")
    if schema.get("additionalProperties", False) is not False:
        raise ValueError("only additionalProperties: false is known")
    is_ = _kinds(value)
    text, real = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    parts = F.try_variant_get(value, "$", "array<variant>")
    none = F.array().cast(_FAULT)
    out: list[Column] = []

    def fault(keyword: str, broken: Column, where: Column = at) -> None:
        out.append(F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(where.alias("location"), F.lit(keyword).alias("keyword"))).cast(_FAULT)).otherwise(none))

    if "$ref" in schema:
        target = root
        for key in schema["$ref"].removeprefix("#/").split("/"):
            target = target[key]
        out.append(schema_faults(value, target, at, root))
    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fault("type", ~F.coalesce(reduce(lambda a, b: a | b, [is_[t] for t in types]), F.lit(False)))
    if "const" in schema or "enum" in schema:
        allowed = [schema["const"]] if "const" in schema else schema["enum"]
        fault("const" if "const" in schema else "enum", ~F.coalesce(F.to_json(value).isin(*[json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in allowed]), F.lit(False)))
    for keyword, broken in (
        ("pattern", lambda x: is_["string"] & ~text.rlike(x)),
        ("minLength", lambda x: is_["string"] & (F.char_length(text) < x)),
        ("maxLength", lambda x: is_["string"] & (F.char_length(text) > x)),
        ("minimum", lambda x: is_["number"] & (real < x)),
        ("maximum", lambda x: is_["number"] & (real > x)),
        ("exclusiveMinimum", lambda x: is_["number"] & (real <= x)),
        ("minItems", lambda x: is_["array"] & (F.size(parts) < x)),
        ("maxItems", lambda x: is_["array"] & (F.size(parts) > x)),
        ("uniqueItems", lambda x: F.lit(bool(x)) & is_["array"] & (F.size(F.array_distinct(F.transform(parts, lambda x: F.to_json(x)))) < F.size(parts))),
    ):
        if keyword in schema:
            fault(keyword, broken(schema[keyword]))
    below = lambda key: F.concat(at, F.lit("." + key))
    for key in schema.get("required", []):
        fault("required", is_["object"] & F.try_variant_get(value, "$" + _step(key), "variant").isNull(), below(key))
    for key, sub in schema.get("properties", {}).items():
        child = F.try_variant_get(value, "$" + _step(key), "variant")
        out.append(F.when(is_["object"] & child.isNotNull(), schema_faults(child, sub, below(key), root)).otherwise(none))
    if "additionalProperties" in schema:
        extra = F.array_except(F.json_object_keys(F.to_json(value)), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))
        out.append(F.when(is_["object"], F.transform(extra, lambda k: F.struct(F.concat(at, F.lit("."), k).alias("location"), F.lit("additionalProperties").alias("keyword")))).otherwise(none))
    place = lambda i: F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
    prefix = schema.get("prefixItems", [])
    for i, sub in enumerate(prefix):
        out.append(F.when(is_["array"] & (F.size(parts) > i), schema_faults(F.get(parts, F.lit(i)), sub, place(F.lit(i)), root)).otherwise(none))
    if "items" in schema:
        rest = F.slice(parts, len(prefix) + 1, F.greatest(F.size(parts) - len(prefix), F.lit(0)))
        own = F.flatten(F.transform(rest, lambda x, i: schema_faults(x, schema["items"], place(i + len(prefix)), root)))
        out.append(F.when(is_["array"], own).otherwise(none))
    if "anyOf" in schema:
        fault("anyOf", reduce(lambda a, b: a & b, [F.size(schema_faults(value, s, at, root)) > 0 for s in schema["anyOf"]]))
    return F.concat(*out) if out else none


# ---- batches ----


def list_batches(spark: SparkSession, runs: list[str], manifest: str = "generation_manifest.json") -> DataFrame:
    """(path, kind, manifest) of named batch folders: kind is missing, file or folder; manifest is its text, null without one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for path in runs:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        kind = "missing" if not fs.exists(p) else "folder" if fs.getFileStatus(p).isDirectory() else "file"
        rows.append((path, kind, kind == "folder" and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{manifest}"))))
    have = [f"{path}/{manifest}" for path, _, found in rows if found]
    named = spark.createDataFrame([(p, k) for p, k, _ in rows], "path string, kind string")
    if not have:
        return named.withColumn("manifest", F.lit(None).cast("string"))
    texts = spark.read.text(have, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("__file"), F.col("value").alias("manifest"))
    return named.withColumn("__file", F.regexp_replace(F.concat("path", F.lit(f"/{manifest}")), "^file:/+", "/")).join(texts, "__file", "left").drop("__file")


def batch_errors(batches: DataFrame, schema: dict) -> DataFrame:
    """(path, code, location, keyword) of batches (path, kind, manifest): what makes a batch unreadable, or every fault of its manifest.

    A batch has one of path_missing, not_a_directory, manifest_missing, manifest_json_invalid, manifest_not_object, or any
    number of manifest_schema rows."""
    v = F.try_parse_json("manifest")
    rows = batches.select("path", "kind", "manifest", v.alias("v"))
    code = F.when(F.col("kind") == "missing", "path_missing").when(F.col("kind") == "file", "not_a_directory").when(F.col("manifest").isNull(), "manifest_missing").when(F.col("v").isNull(), "manifest_json_invalid").when(~_kinds(F.col("v"))["object"], "manifest_not_object")
    rows = rows.withColumn("code", code)
    files = rows.where("code IS NOT NULL").select("path", "code", F.lit("$").alias("location"), F.lit(None).cast("string").alias("keyword"))
    faults = rows.where("code IS NULL").select("path", F.lit("manifest_schema").alias("code"), F.inline(schema_faults(F.col("v"), schema)))
    return files.unionByName(faults)


def validate_batches(batches: DataFrame, schema: dict, rules: DataFrame | None = None) -> DataFrame:
    """A row a batch: path, valid, sample_count, page_count (null if invalid), error (the first by location), n_errors.

    rules: further violations (path, rule), such as those of manifest_violations."""
    errors = batch_errors(batches, schema).select("path", "location", F.concat_ws(" ", "code", "keyword").alias("error"))
    if rules is not None:
        errors = errors.unionByName(rules.select("path", F.lit("~").alias("location"), F.col("rule").alias("error")))
    first = errors.groupBy("path").agg(F.min(F.struct("location", "error")).alias("e"), F.count("*").alias("n_errors"))
    samples = F.try_variant_get(F.try_parse_json("manifest"), "$.samples", "array<variant>")
    pages = F.aggregate(samples, F.lit(0), lambda n, s: n + F.coalesce(F.size(F.try_variant_get(s, "$.pages", "array<variant>")), F.lit(0)))
    counts = batches.select("path", F.size(samples).alias("s"), pages.alias("p"))
    valid = F.col("n_errors").isNull()
    at = F.when(F.col("e.location") == "~", F.col("e.error")).otherwise(F.concat("e.error", F.lit(" at "), "e.location"))
    return counts.join(first, "path", "left").select(
        "path", valid.alias("valid"), F.when(valid, F.col("s")).alias("sample_count"), F.when(valid, F.col("p")).alias("page_count"),
        at.alias("error"), F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"),
    )


# ---- findings of runs, manifests and inventories ----


def _finding(rows: DataFrame, code: Column, path: Column, n: Column | None = None, batch: Column | None = None) -> DataFrame:
    one = F.lit(1) if n is None else n
    batch = F.lit(None) if batch is None else batch
    return rows.select(code.alias("code"), severity_of(code).alias("severity"), batch.cast("string").alias("batch_id"), path.cast("string").alias("source_path"), one.cast("long").alias("n")).where("code IS NOT NULL AND n > 0")


def run_findings(reports: DataFrame) -> DataFrame:
    """Findings of run reports (report: JSON text): not passed, invalid report, unsafe paths of its batches."""
    v = F.try_parse_json("report")
    status = F.try_variant_get(v, "$.status", "string")
    own = _finding(reports, F.when(~status.eqNullSafe(F.lit("passed")), "wet_run_not_passed"), F.lit(RUN_PATH))
    generated, more = F.try_variant_get(v, "$.generated_batch", "variant"), F.try_variant_get(v, "$.supplemental_batches", "variant")
    absent = F.lit(None).cast("variant")
    bad_list = more.isNotNull() & ~F.coalesce(_kinds(more)["array"], F.lit(False))
    every = F.concat(F.array(F.coalesce(generated, absent)), F.coalesce(F.try_variant_get(v, "$.supplemental_batches", "array<variant>"), F.array().cast("array<variant>")))
    rows = reports.select(F.explode(every).alias("b"))
    get = lambda key: F.try_variant_get("b", f"$.{key}", "string")
    shape = ~F.coalesce(_kinds(F.col("b"))["object"], F.lit(False))
    path = F.when(shape, "wet_run_report_invalid").when(~F.coalesce(safe_path(get("batch_path")), F.lit(False)) | ~F.coalesce(safe_path(get("manifest_path")), F.lit(False)), "wet_run_batch_path_invalid")
    return own.unionByName(_finding(reports, F.when(bad_list, "wet_run_report_invalid"), F.lit(RUN_PATH))).unionByName(_finding(rows, path, F.lit(RUN_PATH), batch=get("batch_id")))


def manifest_findings(batches: DataFrame, schema: dict) -> DataFrame:
    """Findings of batches (batch_id, path, kind, manifest) as a whole: paths that leave the run, missing or malformed manifests, samples or pages."""
    v = F.try_parse_json("manifest")
    rows = batches.select("batch_id", "path", "kind", "manifest", v.alias("v"))
    outside = F.when(~F.coalesce(safe_path(F.col("path")), F.lit(False)), "wet_run_path_invalid")
    broken = outside.when((F.col("kind") != "folder") | F.col("manifest").isNull(), "manifest_missing").when(F.col("v").isNull(), "manifest_json_invalid")
    samples = F.try_variant_get("v", "$.samples", "variant")
    listed = samples.isNull() | F.coalesce(_kinds(samples)["array"], F.lit(False))
    whole = broken.when(F.col("v").isNotNull() & ~listed, "manifest_samples_invalid")
    each = rows.select("batch_id", "path", F.explode(F.try_variant_get("v", "$.samples", "array<variant>")).alias("s"))
    is_object = lambda c: F.coalesce(_kinds(c)["object"], F.lit(False))
    pages = F.try_variant_get("s", "$.pages", "variant")
    sample = F.when(~is_object(F.col("s")), "manifest_sample_invalid").when(pages.isNotNull() & ~F.coalesce(_kinds(pages)["array"], F.lit(False)), "manifest_pages_invalid")
    page = each.where(is_object(F.col("s"))).select("batch_id", "path", F.explode(F.try_variant_get("s", "$.pages", "array<variant>")).alias("p"))
    invalid = batch_errors(batches.where(safe_path(F.col("path"))), schema).select("path").distinct().join(batches.select("path", "batch_id").distinct(), "path")
    out = _finding(rows, whole, F.col("path"), batch=F.col("batch_id"))
    out = out.unionByName(_finding(each, sample, F.col("path"), batch=F.col("batch_id")))
    out = out.unionByName(_finding(page, F.when(~is_object(F.col("p")), "manifest_page_invalid"), F.col("path"), batch=F.col("batch_id")))
    return out.unionByName(_finding(invalid, F.lit("batch_validation_failed"), F.col("path"), batch=F.col("batch_id")))


def inventory_findings(counts: DataFrame | None, inventory: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings of a checksum inventory: missing as a whole (counts None), bad lines, and expected artifacts (path) it does not list.

    counts: malformed, unsafe, duplicate of parse_checksums."""
    absent = expected.where(safe_path(F.col("path"))).select("path").distinct().join(inventory, "path", "left_anti")
    out = _finding(absent, F.lit("checksum_inventory_missing_expected_artifact"), F.col("path"))
    if counts is None:
        one = expected.sparkSession.range(1)
        return out.unionByName(_finding(one, F.lit("checksum_inventory_missing"), F.lit(INVENTORY_PATH)))
    for code, column in (("malformed", "malformed"), ("unsafe_path", "unsafe"), ("duplicate_path", "duplicate")):
        out = out.unionByName(_finding(counts, F.lit(f"checksum_inventory_{code}"), F.lit(INVENTORY_PATH), F.col(column)))
    return out


# ---- reports ----

_PLAIN = ["template_id", "recipe_id", "layout_style", "font_style", "font_id", "degradation_preset"]
_RICH = ["document_family", "base_family", "page_regions", "annotation_types", "identifier_types", "layout_density", "review_features"]


def catalog_report(catalog: DataFrame, rich: bool = False) -> DataFrame:
    """One row, report: the catalogue as JSON, templates in order of their ids.  A catalogue is a small table by nature."""
    entry = F.struct(*(_PLAIN + _RICH if rich else _PLAIN))
    templates = F.array_sort(F.collect_list(entry))
    return catalog.agg(F.to_json(F.struct(F.lit(RICH_CATALOG if rich else CATALOG).alias("schema_version"), templates.alias("templates"))).alias("report"))


def validation_reports(results: DataFrame) -> DataFrame:
    """(path, report) of validate_batches: counts of valid batches, the error of others; absent fields are left out."""
    fields = F.struct(F.lit(VALIDATION_REPORT).alias("schema_version"), "valid", "sample_count", "page_count", "path", "error")
    return results.select("path", F.to_json(fields).alias("report"))


def generation_reports(results: DataFrame, sidecars: dict[str, str] | None = None) -> DataFrame:
    """(path, report) of generated batches with their counts; sidecars: field to file name below the batch."""
    more = [F.concat("path", F.lit(f"/{name}")).alias(field) for field, name in (sidecars or {}).items()]
    fields = F.struct(F.lit(GENERATION_REPORT).alias("schema_version"), "sample_count", "page_count", F.col("path").alias("output_path"), F.concat("path", F.lit("/generation_manifest.json")).alias("manifest_path"), *more)
    return results.where("valid").select("path", F.to_json(fields).alias("report"))


def evidence_report(head: dict[str, str | int], template_ids: list[str], reports: dict[str, DataFrame]) -> DataFrame:
    """One row, report: a run's head, its templates, and the one-row reports it captured, by name, as JSON."""
    spark = next(iter(reports.values())).sparkSession
    out = spark.range(1).select(F.lit(EVIDENCE).alias("schema_version"), F.lit(False).alias("release_eligible"), *[F.lit(v).alias(k) for k, v in head.items()], F.array(*map(F.lit, template_ids)).cast("array<string>").alias("template_ids"))
    own = None
    for name, d in reports.items():
        one = d.agg(F.parse_json(F.max("report")).alias(name))
        own = one if own is None else own.crossJoin(one)
    return out.crossJoin(own.select(F.struct(*reports).alias("reports"))).select(F.to_json(F.struct("*")).alias("report"))
