"""Batches as one call, run and inventory findings, bands, profile gaps and cap decisions."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import governance as G
from corpusloom.operators import validation as V

SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["version", "samples"],
    "properties": {
        "version": {"const": "1.0"},
        "samples": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/sample"}},
        "size": {"type": "array", "prefixItems": [{"type": "integer"}, {"type": "string"}], "maxItems": 2},
        "kind": {"anyOf": [{"type": "null"}, {"enum": ["a", "b"]}]},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2, "maxLength": 3}, "uniqueItems": True},
        "weight": {"type": "number", "exclusiveMinimum": 0, "maximum": 5},
    },
    "$defs": {"sample": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^s[0-9]+$"}, "pages": {"type": "array"}, "n": {"type": "integer", "minimum": 1}}}},
}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def faults(spark, value):
    text = value if isinstance(value, str) else json.dumps(value)
    got = frame(spark, [(text,)], "j string").select(F.inline(V.schema_faults(F.try_parse_json("j"), SCHEMA)))
    return sorted((r.location, r.keyword) for r in got.collect())


CHANGES = [
    ({}, []),
    ({"version": "2"}, [("$.version", "const")]),
    ({"version": None}, [("$.version", "const")]),
    ({"samples": []}, [("$.samples", "minItems")]),
    ({"samples": [{"id": "s1", "n": 1.0}, {"id": "x", "n": 0}, 3, {}]}, [("$.samples[1].id", "pattern"), ("$.samples[1].n", "minimum"), ("$.samples[2]", "type"), ("$.samples[3].id", "required")]),
    ({"size": [1.5, "x", 0]}, [("$.size", "maxItems"), ("$.size[0]", "type")]),
    ({"size": [2]}, []),
    ({"kind": None}, []),
    ({"kind": "c"}, [("$.kind", "anyOf")]),
    ({"tags": ["ab", "ab", "c", "long"]}, [("$.tags", "uniqueItems"), ("$.tags[2]", "minLength"), ("$.tags[3]", "maxLength")]),
    ({"weight": 0}, [("$.weight", "exclusiveMinimum")]),
    ({"weight": 5.5, "odd": 1}, [("$.odd", "additionalProperties"), ("$.weight", "maximum")]),
    ({"weight": True}, [("$.weight", "type")]),
]


def test_schema_faults(spark):
    data = [(i, json.dumps({"version": "1.0", "samples": [{"id": "s1"}]} | change)) for i, (change, _) in enumerate(CHANGES)]
    got = frame(spark, data, "i int, j string").select("i", F.inline(V.schema_faults(F.try_parse_json("j"), SCHEMA))).collect()
    for i, (_, want) in enumerate(CHANGES):
        assert sorted((r.location, r.keyword) for r in got if r.i == i) == want, CHANGES[i]


def test_schema_faults_of_other_roots(spark):
    assert faults(spark, [1]) == [("$", "type")]
    assert ("$", "type") in faults(spark, "{bad")
    with pytest.raises(ValueError, match="unknown schema keywords"):
        V.schema_faults(F.col("v"), {"oneOf": []})


def test_validate_batches_reads_folders(spark, tmp_path):
    good = {"version": "1.0", "samples": [{"id": "s1", "pages": [{}, {}]}, {"id": "s2", "pages": [{}]}]}
    for name, text in (("good", json.dumps(good)), ("cut", "{\"version\":"), ("list", "[]"), ("odd", json.dumps({"samples": [{"id": "x"}]})), ("none", None)):
        (tmp_path / name).mkdir()
        if text is not None:
            (tmp_path / name / "generation_manifest.json").write_text(text)
    (tmp_path / "plain").write_text("x")
    names = ["good", "cut", "list", "odd", "none", "plain", "gone"]
    batches = V.list_batches(spark, [f"{tmp_path}/{n}" for n in names])
    got = {r.path.rsplit("/", 1)[1]: r for r in V.validate_batches(batches, SCHEMA).collect()}
    assert (got["good"].valid, got["good"].sample_count, got["good"].page_count, got["good"].error) == (True, 2, 3, None)
    assert {n: got[n].error for n in names[1:]} == {
        "cut": "manifest_json_invalid at $", "list": "manifest_not_object at $", "odd": "manifest_schema pattern at $.samples[0].id",
        "none": "manifest_missing at $", "plain": "not_a_directory at $", "gone": "path_missing at $",
    }
    assert (got["odd"].n_errors, got["odd"].sample_count) == (2, None)
    rules = frame(spark, [(f"{tmp_path}/good", "recipe")], "path string, rule string")
    assert [r.error for r in V.validate_batches(batches, SCHEMA, rules).where("path LIKE '%good'").collect()] == ["recipe"]
    reports = {json.loads(r.report)["path"].rsplit("/", 1)[1]: json.loads(r.report) for r in V.validation_reports(V.validate_batches(batches, SCHEMA)).collect()}
    assert reports["good"] == {"schema_version": "validation_report.v1", "valid": True, "sample_count": 2, "page_count": 3, "path": f"{tmp_path}/good"}
    assert set(reports["gone"]) == {"schema_version", "valid", "path", "error"}
    made = V.generation_reports(V.validate_batches(batches, SCHEMA), {"paired_render_path": "pairs.json"}).collect()
    assert [json.loads(r.report)["paired_render_path"] for r in made] == [f"{tmp_path}/good/pairs.json"]


def codes(df):
    return sorted((r.code, r.severity, r.batch_id, r.n) for r in df.collect())


def test_run_findings(spark):
    ok = {"batch_id": "b", "batch_path": "batches/b", "manifest_path": "batches/b/m.json"}
    runs = [{"status": "passed", "generated_batch": ok, "supplemental_batches": [ok]}]
    assert codes(V.run_findings(frame(spark, [(json.dumps(r),) for r in runs], "report string"))) == []
    bad = {"status": "failed", "supplemental_batches": [ok | {"batch_path": "../x"}, 3]}
    assert codes(V.run_findings(frame(spark, [(json.dumps(bad),)], "report string"))) == [
        ("wet_run_batch_path_invalid", "P0", "b", 1), ("wet_run_not_passed", "P0", None, 1), ("wet_run_report_invalid", "P0", None, 1), ("wet_run_report_invalid", "P0", None, 1),
    ]
    odd = json.dumps({"status": "passed", "generated_batch": ok, "supplemental_batches": {}})
    assert [c[0] for c in codes(V.run_findings(frame(spark, [(odd,)], "report string")))] == ["wet_run_report_invalid"]
    assert {c[0] for c in codes(V.run_findings(frame(spark, [("{",), (None,)], "report string")))} == {"wet_run_not_passed", "wet_run_report_invalid"}


def test_manifest_findings(spark):
    good = json.dumps({"version": "1.0", "samples": [{"id": "s1", "pages": [{}]}]})
    rows = [
        ("ok", "r/ok", "folder", good), ("out", "../x", "folder", good), ("none", "r/none", "folder", None), ("cut", "r/cut", "folder", "{"),
        ("samples", "r/samples", "folder", '{"samples": 3}'), ("mixed", "r/mixed", "folder", '{"version": "1.0", "samples": [1, {"id": "s1", "pages": 2}, {"id": "s2", "pages": [7, {}]}]}'),
    ]
    got = codes(V.manifest_findings(frame(spark, rows, "batch_id string, path string, kind string, manifest string"), SCHEMA))
    assert [(c, b) for c, _, b, _ in got] == sorted([
        ("wet_run_path_invalid", "out"), ("manifest_missing", "none"), ("manifest_json_invalid", "cut"), ("manifest_samples_invalid", "samples"),
        ("manifest_sample_invalid", "mixed"), ("manifest_pages_invalid", "mixed"), ("manifest_page_invalid", "mixed"),
        *[("batch_validation_failed", b) for b in ("none", "cut", "samples", "mixed")],
    ])


def test_inventory_findings(spark):
    inventory = frame(spark, [("a", "0" * 64)], "path string, digest string")
    expected = frame(spark, [("a",), ("b",), ("../c",), (None,)], "path string")
    counts = frame(spark, [(2, 0, 1)], "malformed long, unsafe long, duplicate long")
    assert [(c, n) for c, _, _, n in codes(V.inventory_findings(counts, inventory, expected))] == [("checksum_inventory_duplicate_path", 1), ("checksum_inventory_malformed", 2), ("checksum_inventory_missing_expected_artifact", 1)]
    assert "checksum_inventory_missing" in {c[0] for c in codes(V.inventory_findings(None, inventory.limit(0), expected))}


def test_catalog_and_evidence_reports(spark):
    plain = "template_id string, recipe_id string, layout_style string, font_style string, font_id string, degradation_preset string"
    catalog = frame(spark, [("t2", "r", "l", "f", "i", "d"), ("t1", "r", "l", "f", "i", "d")], plain)
    report = json.loads(V.catalog_report(catalog).first().report)
    assert (report["schema_version"], [t["template_id"] for t in report["templates"]]) == ("template_catalog.v1", ["t1", "t2"])
    assert json.loads(V.catalog_report(catalog.limit(0)).first().report)["templates"] == []
    run = json.loads(V.evidence_report({"count": 2, "output_root": "x"}, ["t1"], {"template_catalog_v1": V.catalog_report(catalog)}).first().report)
    assert run["release_eligible"] is False and run["count"] == 2 and run["reports"]["template_catalog_v1"] == report


METRIC = "pattern string, stratum string, value double, non_default long, claimed boolean, strict boolean, tiny boolean"


LEVELS = [
    (("duplicate_text", 0.05, None, True, None, None), "ok"),
    (("duplicate_text", 0.06, None, True, None, None), "warn"),
    (("duplicate_text", 0.21, None, True, None, None), "hold"),
    (("duplicate_text", 0.21, None, True, None, True), "info"),
    (("duplicate_text", 0.21, None, None, None, None), "ok"),
    (("font_skew", 0.99, None, True, None, None), "warn"),
    (("font_skew", 1.0, None, True, None, None), "hold"),
    (("style_control_skew", 0.2, 4, True, None, None), "warn"),
    (("style_control_skew", 0.2, 0, True, None, None), "hold"),
    (("style_control_skew", 0.9, 9, True, None, None), "warn"),
    (("condition_control_skew", 0.8, 5, True, None, None), "ok"),
    (("seed_contiguity_risk", 1.0, None, True, False, None), "warn"),
    (("seed_contiguity_risk", 1.0, None, True, True, None), "hold"),
    (("unreviewed_stratum", 0.0, None, True, True, None), "hold"),
    (("text_feature_gap", 0.1, None, True, True, None), "ok"),
    (("coverage_sidecar_gap", 1.0, None, True, False, None), "warn"),
    (("synthetic_artifact_repetition", 2.0, None, True, True, None), "hold"),
]


def test_skew_bands(spark):
    data = [(row[0], str(i), *row[1:]) for i, (row, _) in enumerate(LEVELS)]
    got = {int(r.stratum): r.level for r in G.skew_bands(frame(spark, data, METRIC)).collect()}
    assert got == {i: level for i, (_, level) in enumerate(LEVELS)}


def test_skew_bands_of_unknown_rows(spark):
    assert G.skew_bands(frame(spark, [("other", "s", 1.0, None, True, True, None), ("font_skew", "s", None, None, True, True, None)], METRIC)).count() == 0


def test_profile_gaps(spark):
    cols = "dimension string, stratum string, class string, max_share double, max_n long, least_n long, is_default boolean, requested long, observed long, reviewed long, capped long, released long"
    rows = [
        ("template_id", "a", "required", 0.5, None, None, None, 5, 8, 0, 8, None),
        ("template_id", "b", "required", None, None, None, None, 5, 0, 0, 0, None),
        ("template_id", "c", "excluded", None, None, None, None, None, 1, 1, 0, None),
        ("font_id", "f", None, 0.5, 3, None, None, 4, 9, 9, 9, None),
        ("persona", "default", None, None, None, 3, True, None, 7, None, None, None),
        ("persona", "bold", "required", None, None, 3, False, None, 2, 2, 0, None),
        ("lang", "x", "preferred", 0.1, None, None, None, None, 5, 5, 5, None),
    ]
    profile = frame(spark, [("seed_concentration", True), ("domain_shift_unmeasured", False), ("other", True), ("forbidden_claim_risk", None)], "reason string, broken boolean")
    got = sorted((r.reason, r.layer, r.stratum or "", r.n if r.n is not None else -1) for r in G.profile_gaps(frame(spark, rows, cols), profile).collect())
    assert got == sorted([
        ("overrepresented_template", "observed", "a", 8), ("unreviewed_requested_stratum", "reviewed", "a", 0), ("missing_stratum", "observed", "b", 0),
        ("cap_conflict", "observed", "c", 1), ("degradation_or_font_skew", "observed", "f", 9), ("cap_conflict", "observed", "f", 9), ("cap_conflict", "requested", "f", 4),
        ("insufficient_non_default_style_coverage", "observed", "", 2), ("missing_stratum", "capped", "bold", 0), ("seed_concentration", "profile", "", -1),
    ])


def test_cap_status(spark):
    flags = ", ".join(f"{c} boolean" for c in G.EVIDENCE)
    cols = f"slice string, purpose string, n long, others long, max_n long, max_share double, {flags}"
    none = (None,) * len(G.EVIDENCE)
    mark = lambda c: tuple(x == c for x in G.EVIDENCE)
    rows = [
        ("fits", "release", 10, 90, 10, 0.1, *none), ("share", "dry_run", 20, 90, None, 0.1, *none), ("count", "utility", 20, 0, 8, None, *none),
        ("stratum", "release", 10, 0, None, None, *none), ("nothing", "release", 5, 0, None, 0.2, *none), ("leak", "release", 1, 9, None, None, *mark("leakage")),
        ("unseen", "release", 1, 9, None, None, *mark("unreviewed")), ("probe", "diagnostic", 9, 1, 2, None, *none), ("odd", None, 1, 9, None, None, *none),
    ]
    strata = frame(spark, [("stratum", "font_id", 6, 4), ("stratum", "persona", 5, 4), ("fits", "font_id", 1, 4)], "slice string, dimension string, n long, max_n long")
    got = {r.slice: (r.status, r.admitted, r.reasons) for r in G.cap_status(frame(spark, rows, cols), strata).collect()}
    fit = "within_release_profile_cap"
    assert got == {
        "fits": ("admit_for_release", 10, [fit]), "share": ("admit_reduced", 10, ["synthetic_percentage_cap_exceeded"]), "count": ("admit_reduced", 8, ["synthetic_absolute_cap_exceeded"]),
        "stratum": ("admit_reduced", 8, ["degradation_or_font_cap_exceeded", "style_or_condition_cap_exceeded"]), "nothing": ("reject", 0, ["synthetic_percentage_cap_exceeded"]),
        "leak": ("reject", 0, ["leakage_or_contamination_risk", fit]), "unseen": ("hold", 0, ["review_evidence_insufficient", fit]), "probe": ("diagnostic_only", 0, ["synthetic_absolute_cap_exceeded"]), "odd": ("hold", 0, [fit]),
    }
