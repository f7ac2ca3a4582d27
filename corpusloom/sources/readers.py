"""Readers and writers: line corpora, JSON lines, manifests, review sheets, checksum files, registries, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.batch import REVIEW_FIELDS, safe_path

MANIFEST = (
    "manifest_version string, generator_name string, license string, synthetic_disclosure string, samples array<struct<"
    "sample_id: string, pages: array<struct<page_id: string, asset_path: string, media_type: string, sha256: string, width: int, height: int>>,"
    "text: struct<logical_order: string, script: string, language: string, direction: string, unicode_normalization: string>,"
    "generator_version: string, recipe_id: string, provenance: struct<seed: bigint, sample_index: int, template_id: string, recipe_id: string,"
    "degradation_preset: string, font_id: string, source_corpus: string, composition_mode: string>, license: string, synthetic_disclosure: string,"
    "controls: struct<persona: string, condition: string>>>"
)
GLYPHS = "glyph_id string, style_id string, char string, asset_path string, mask_path string, size array<int>, ink_box array<int>, baseline_y int, x_height_px double, source struct<page_id: string>, quality struct<score: double>"
STYLES = "style_id string, source_id string, work_id string, licence string, attribution string, born_digital boolean, glyph_count int"


def read_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(corpus, line_no from 0, line) of text files.

    Stripped lines at any line end without blank ones; or, strict, the pieces between line feeds as they are."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("corpus"), "value")
    cut = T.lines_strict(F.col("value")) if strict else T.lines_stripped(F.col("value"))
    return whole.select("corpus", F.posexplode(cut).alias("line_no", "line"))


def read_records(spark: SparkSession, path: str, required: list[str], optional: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """JSON lines with required strings: good rows, and bad ones as (raw, reason)."""
    schema = ", ".join(f"`{c}` string" for c in [*required, *optional])
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("r", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.when(F.col("r._corrupt_record").isNotNull(), "not_json")
    for c in required:
        bad = bad.when(F.coalesce(F.col(f"r.{c}"), F.lit("")) == "", f"missing_{c}")
    rows = rows.withColumn("reason", bad)
    return rows.where("reason IS NULL").select(*[F.col(f"r.{c}").alias(c) for c in [*required, *optional]]), rows.where("reason IS NOT NULL").select(F.col("value").alias("raw"), "reason")


def read_manifests(spark: SparkSession, path: str, version: str = "1.0") -> DataFrame:
    """Manifests of one version, a row a file, batch_id from the folder's name."""
    df = spark.read.schema(MANIFEST).json(path, multiLine=True)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select(folder.alias("batch_id"), "*").where(F.col("manifest_version") == version)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet by its suffix: .csv, .jsonl or .ndjson; (line, fields, reason_codes array, parse_error)."""
    if path.endswith(".csv"):
        return read_review_csv(spark, path)
    if path.endswith((".jsonl", ".ndjson")):
        return read_review_jsonl(spark, path)
    raise ValueError(f"unknown review format: {path}")


def _codes(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,|]"), F.trim), lambda x: x != "")


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header that names every field; a missing one becomes a parse error row.  Line numbers count from 2."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [c for c in REVIEW_FIELDS if c not in df.columns]
    line = (F.monotonically_increasing_id() + 2).alias("line")
    value = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    fields = [value(c).alias(c) for c in REVIEW_FIELDS if c != "reason_codes"]
    error = F.lit(f"missing_csv_field: {', '.join(missing)}" if missing else None).cast("string").alias("parse_error")
    return df.coalesce(1).select(line, *fields, _codes(value("reason_codes")).alias("reason_codes"), error)


def read_review_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that does not parse is a row with parse_error, booleans and nulls become text."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "value")).where(F.trim("value") != "")
    flat = [c for c in REVIEW_FIELDS if c != "reason_codes"]
    get = lambda c: F.coalesce(F.get_json_object("value", f"$.{c}"), F.lit(""))
    listed = F.from_json(F.get_json_object("value", "$.reason_codes"), "array<string>")
    codes = F.coalesce(listed, _codes(F.get_json_object("value", "$.reason_codes")))
    valid = F.is_valid_json("value") if hasattr(F, "is_valid_json") else F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    return raw.select((F.col("at") + 1).cast("long").alias("line"), *[F.trim(get(c)).alias(c) for c in flat], codes.alias("reason_codes"), F.when(~valid, "invalid_jsonl_row").alias("parse_error"))


def parse_checksums(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (line_no, value) of "digest␠␠path": the inventory, last line of a path wins, and counts of bad lines."""
    parts = F.split("value", "  ", 2)
    rows = lines.where(F.trim("value") != "").select("line_no", F.get(parts, F.lit(0)).alias("digest"), F.get(parts, F.lit(1)).alias("path"))
    good = F.col("path").isNotNull() & F.col("digest").rlike("^[0-9a-f]{64}$")
    rows = rows.withColumn("kind", F.when(~good, "malformed").when(~safe_path(F.col("path")), "unsafe").otherwise("good"))
    inventory = rows.where("kind = 'good'").groupBy("path").agg(F.max_by("digest", "line_no").alias("digest"), F.count("*").alias("n"))
    counts = rows.agg(F.count_if(F.col("kind") == "malformed").alias("malformed"), F.count_if(F.col("kind") == "unsafe").alias("unsafe")).crossJoin(inventory.agg(F.count_if(F.col("n") > 1).alias("duplicate")))
    return inventory.select("path", "digest"), counts


def read_checksums(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    whole = spark.read.text(path, wholetext=True)
    return parse_checksums(whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of the bytes of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A small registry of "- key: value" items with indented "key: value" lines: (item, key, value)."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    m = whole.select("at", F.col("line").rlike(r"^\s*-\s").cast("int").alias("new"), F.regexp_extract("line", r"^\s*-?\s*([A-Za-z0-9_]+):\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("line", r"^\s*-?\s*([A-Za-z0-9_]+):\s*(.*?)\s*$", 2).alias("raw")).where("key <> ''")
    from pyspark.sql import Window

    item = F.sum("new").over(Window.orderBy("at"))  # a registry is one small file
    return m.select(item.alias("item"), "key", F.regexp_replace("raw", "^[\"']|[\"']$", "").alias("value")).where("item > 0")


def batch_list(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches of run reports (generated_batch struct, supplemental_batches array): good ones in order, and bad ones with a reason."""
    every = F.concat(F.array("generated_batch"), F.coalesce("supplemental_batches", F.array().cast(runs.schema["supplemental_batches"].dataType)))
    rows = runs.select(F.posexplode(every).alias("pos", "b")).select("pos", "b.*")
    reason = F.when(F.coalesce("batch_id", F.lit("")) == "", "batch_id").when(~F.coalesce(safe_path(F.col("batch_path")), F.lit(False)), "batch_path").when(~F.coalesce(safe_path(F.col("manifest_path")), F.lit(False)), "manifest_path")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def read_bank(spark: SparkSession, index: str, glyphs: str) -> tuple[DataFrame, DataFrame]:
    """Styles of an index file and glyphs of a JSON lines file."""
    styles = spark.read.schema(f"styles array<struct<{STYLES.replace(' string', ': string').replace(' boolean', ': boolean').replace(' int', ': int')}>>").json(index, multiLine=True)
    return styles.select(F.inline("styles")), spark.read.schema(GLYPHS).json(glyphs)


# ---- writers ----


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON with keys in order."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    df.select(sorted_json(df).alias("value")).write.mode("errorifexists").text(path)


def write_template(df: DataFrame, path: str, kind: str) -> None:
    """A worksheet as one file, CSV with a header or JSON lines."""
    out = df.coalesce(1).write.mode("errorifexists")
    out.option("header", "true").csv(path) if kind == "csv" else out.json(path)


def write_checksums(files: DataFrame, path: str) -> None:
    """"digest␠␠path" lines in path order."""
    files.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def publish(spark: SparkSession, write, path: str) -> dict:
    """Write beside the target, then rename; a failure leaves no target and is returned as a report."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    part = f"{path}.part-{uuid.uuid4().hex}"
    if fs.exists(target):
        return {"status": "failed", "reason": "target exists", "path": path}
    try:
        write(part)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(part), target):
            raise OSError("rename refused")
    except Exception as e:  # reported, not raised: the caller records failed runs
        fs.delete(jvm.org.apache.hadoop.fs.Path(part), True)
        return {"status": "failed", "reason": f"{type(e).__name__}: {str(e)[:200]}", "path": path}
    return {"status": "published", "path": path}


def html_report(title: str, columns: list[str], rows: list[tuple]) -> str:
    """A static table page of a small, already limited list of rows."""
    from html import escape

    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>\n'


def markdown_report(title: str, columns: list[str], rows: list[tuple]) -> str:
    line = lambda vs: "| " + " | ".join(str(v).replace("|", "\\|") for v in vs) + " |"
    return "\n".join([f"# {title}", "", line(columns), line(["---"] * len(columns)), *map(line, rows), ""])
