"""Batch, bank, order and statistics operators on small frames: each rule hit and missed."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bank, batch
from corpusloom.operators import corpus_stats as S
from corpusloom.operators import leakage as L
from corpusloom.operators import windows as W
from corpusloom.sources import readers as R


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_overlap_measures_differ_where_they_should(spark):
    src = frame(spark, [("a b c d",), ("x y z",), ("e\u0301 f g",)], "line string")
    dst = frame(spark, [("a b c d",), ("a b c d",), ("q r s t",), ("\u00e9 f g",)], "line string")
    assert rows(L.gram_overlap(src, dst), "target_grams", "shared_grams", "shared_lines") == [(5, 2, 1)]
    assert rows(L.gram_overlap(src, dst, normal=True, per_line=True), "target_grams", "shared_grams", "shared_lines") == [(5, 3, 3)]
    d = {r.measure: (r.total, r.seen) for r in L.directed_overlap(src, dst).collect()}
    assert d["word3_tokens"] == (7, 4) and d["word3_types"] == (5, 2) and d["lines"] == (3, 1)
    assert rows(L.gram_overlap(src, dst.limit(0)), "target_grams", "share") == [(0, 0.0)]
    fix = L.hash_fixture(dst)
    assert rows(L.hashed_overlap(src, fix), "kind", "total", "shared") == [("line", 3, 2), ("word3", 4, 3)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_reads_the_source_once(spark, tmp_path):
    frame(spark, [("a b c d",), ("e\u0301 f  g",), ("",), (None,)], "line string").write.parquet(str(tmp_path / "src"))
    src, dst = spark.read.parquet(str(tmp_path / "src")), frame(spark, [("\u00e9 f g",), ("\u00e9 f  g",), ("\u00e9 f  g",), ("b c d e",)], "line string")
    df = L.gram_overlap(src, dst, normal=True, per_line=True)
    assert rows(df, "target_grams", "shared_grams", "shared_lines") == [(3, 2, 2)]
    assert plan(df).count("] parquet") == 1


def test_grams_by_place_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("ab \u00e9\U0001f600") for _ in range(n)).strip() or "x"
    for char_n in (1, 5):
        src, dst = ([line(rng.choice([*range(1, 9), 63, 64, 65, 67, 68, 69, 70, 128, 133, 400])) for _ in range(60)] for _ in range(2))
        word = lambda of, n: [" ".join(w[i : i + n]) for x in of for w in [x.split()] for i in range(len(w) - n + 1)]
        chars = lambda of: {x[i : i + char_n] for x in of for i in range(len(x) - char_n + 1)}  # noqa: B023, E731
        want = {"lines": (len(set(dst)), len(set(dst) & set(src))), f"char{char_n}_types": (len(chars(dst)), len(chars(dst) & chars(src)))}
        for n in (1, 2, 3):
            own, other = word(dst, n), set(word(src, n))
            want |= {f"word{n}_types": (len(set(own)), len(set(own) & other)), f"word{n}_tokens": (len(own), sum(g in other for g in own))}
        df = L.directed_overlap(frame(spark, [(x,) for x in src], "line string"), frame(spark, [(x,) for x in dst], "line string"), char_n=char_n)
        assert {r.measure: (r.total, r.seen) for r in df.collect()} == want
        assert "transform(sequence" not in plan(df)  # no list of a line's grams


def test_hashed_overlap_moves_hashes_only(spark):
    src = frame(spark, [("a b c d",), ("a b c d",), ("b c  d",), (" ",), (None,), ("q",)], "line string")
    fix = L.hash_fixture(frame(spark, [("q",), ("a b c",), ("z",)], "line string"))
    df = L.hashed_overlap(src, fix)
    assert rows(df, "kind", "total", "shared") == [("line", 3, 1), ("word3", 2, 1)]
    assert "Aggregate [high#" in plan(df)
    most, L.BROADCAST_GRAMS = L.BROADCAST_GRAMS, 0
    try:
        assert rows(L.hashed_overlap(src, fix), "kind", "total", "shared") == [("line", 3, 1), ("word3", 2, 1)]
    finally:
        L.BROADCAST_GRAMS = most


def test_pools_give_the_hit_to_the_first(spark):
    lines = frame(spark, [(1, 0, "one two three four five six seven"), (1, 1, "alpha beta gamma delta epsilon zeta"), (2, 0, "short line")], "id long, line_no int, line string")
    pools = [("a", frame(spark, [("Two, three four five six seven",)], "line string")), ("b", frame(spark, [("one two three four five six",), ("alpha beta gamma delta epsilon zeta",)], "line string"))]
    assert rows(L.pool_hits(lines, pools), "id", "line_no", "pool") == [(1, 0, "a"), (1, 1, "b")]
    assert rows(L.decontaminated(lines, pools), "id", "line_no") == [(2, 0)]
    assert L.control_hits(lines.where("id = 1"), pools).first().ok and not L.control_hits(lines, pools).first().ok


def test_duplicates_and_near_duplicates(spark):
    docs = frame(spark, [(1, "a  b"), (2, "a b"), (3, "c"), (4, None), (5, "a b ")], "id long, t string")
    assert rows(L.duplicate_rows(docs, "t", "id"), "id", "seen_before") == [(1, False), (2, True), (3, False), (4, False), (5, True)]
    assert L.duplicate_rate(frame(spark, [("x",), ("x",), ("y",)], "k string"), "k").first()[:] == (1, 1, 3, pytest.approx(1 / 3, abs=1e-6))
    base = [f"w{i}" for i in range(40)]
    sets = [(i, [*base[:-1], f"e{i}"]) for i in range(6)] + [(9, base[:20]), (10, base), (11, base)]
    got = rows(L.near_duplicate_pairs(frame(spark, sets, "id long, s array<string>"), "id", F.col("s"), 90), "a", "b")
    real = {k: set(v) for k, v in sets if k != 11}
    want = sorted(((a, b) for a in real for b in real if a < b and 10 * len(real[a] & real[b]) >= 9 * len(real[a] | real[b])), key=str)
    assert got == want
    assert rows(L.multiset_difference(frame(spark, [("x",)] * 3, "t string"), frame(spark, [("x",), ("y",)], "t string"), ["t"]), "t", "missed", "extra", "common") == [("x", 2, 0, 1), ("y", 0, 1, 0)]


def test_near_duplicates_of_common_elements_have_few_candidates(spark):
    import random

    rng = random.Random(5)
    sets = [(i, rng.sample([f"w{k}" for k in range(120)], 60)) for i in range(300)]  # every element is in half of the sets
    sets += [(500 + i, [*sets[i][1][:-1], f"e{i}"]) for i in range(20)]
    sets += [(7, sets[1][1][:-2]), (None, sets[2][1]), (900, [])]  # a repeated id, no id, no elements
    sets += [(910 + i, ["a\nb", "", *[f"n{k}" for k in range(30)], f"m{i}"]) for i in range(3)] + [(920, ["a", "b", "", *[f"n{k}" for k in range(30)], "m0"])]  # line ends in elements
    sets += [(1000 + i, [f"h{k}" for k in range(60) if k != i % 30 and k != 30 + i // 30]) for i in range(300)]  # a large group of near copies
    docs = frame(spark, sets, "id long, s array<string>")
    want = sorted((a, b, len(x & y), len(x | y)) for a, x in ((k, set(v)) for k, v in sets if k is not None) for b, y in ((k, set(v)) for k, v in sets if k is not None) if a < b and 10 * len(x & y) >= 9 * len(x | y) and x | y)
    assert sorted(map(tuple, L.near_duplicate_pairs(docs, "id", F.col("s"), 90).collect())) == want
    square, L.SQUARE = L.SQUARE, 8
    try:
        assert sorted(map(tuple, L.near_duplicate_pairs(docs, "id", F.col("s"), 90).collect())) == want
    finally:
        L.SQUARE = square
    low = sorted((a, b) for a, x in ((k, set(v)) for k, v in sets[:330] if k is not None) for b, y in ((k, set(v)) for k, v in sets[:330] if k is not None) if a < b and 10 * len(x & y) >= 4 * len(x | y) and x | y)
    assert rows(L.near_duplicate_pairs(docs.where("id < 1000 OR id IS NULL"), "id", F.col("s"), 40), "a", "b") == sorted((t for t in low if max(t) < 1000), key=str)
    few = docs.where("id < 300 AND size(s) > 0").select("id", "s", F.xxhash64("s").alias("h"))
    assert L._by_parts(few, 90).count() < 300  # of 44,850 pairs, nearly all of which share a rarest element


def test_strata_and_fits(spark):
    df = frame(spark, [("a", None, 1), ("a", "x", 2), ("b", "x", 3), ("a", "x", 7)], "p string, q string, k int")
    assert rows(S.stratum_counts(df, ["p", "q"]), "dimension", "value", "n") == [("p", "a", 3), ("p", "b", 1), ("q", "x", 3), ("q", None, 1)]
    assert rows(S.distinct_values(df, ["p", "q"]), "dimension", "n") == [("p", 2), ("q", 2)]
    assert S.span_summary(df, "k", []).first().longest_run == 3
    long = spark.range(4090, 4105).selectExpr("id AS k")  # across a range border
    assert S.span_summary(long, "k", []).first().longest_run == 15
    ks = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0)], "s string, v double")
    r = S.ks_wasserstein(ks, "v", "s", "a", "b").first()
    assert (r.ks, r.w1) == (pytest.approx(0.5), pytest.approx(1.0))
    dice = frame(spark, [(i, 1 / 6) for i in range(1, 7)], "value int, p double")
    assert S.convolve(dice, 2, 10).first().tail == pytest.approx(3 / 36)
    boot = frame(spark, [(f"c{i}", 10 + i % 3, 9, 100) for i in range(30)], "c string, a int, b int, n int")
    r = S.bootstrap(boot, "c", "a", "b", "n", 500).first()
    assert r.low <= r.delta <= r.high and r.a_rate == pytest.approx(0.11)
    import numpy as np

    data = [(f"unit-{i % 3}-{i:08d}", 5 * i % 17, 3 * i % 11, 100 + 7 * i) for i in range(12)]
    r = S.bootstrap(frame(spark, data, "c string, a int, b int, n int"), "c", "a", "b", "n", 2000, seed=3).first()
    v = np.array([x[1:] for x in sorted(data)], float)
    d = v[np.random.default_rng(3).integers(0, 12, size=(2000, 12))].sum(axis=1)
    delta = d[:, 0] / d[:, 2] - d[:, 1] / d[:, 2]
    assert (r.low, r.high) == (pytest.approx(np.percentile(delta, 2.5)), pytest.approx(np.percentile(delta, 97.5)))
    many = S.bootstrap(frame(spark, data, "c string, a int, b int, n int"), "c", "a", "b", "n", 2000, seed=3, chunk=3).first()
    assert abs(many.low - r.low) < 0.01 and abs(many.high - r.high) < 0.01 and many.delta == pytest.approx(r.delta)
    ks = spark.range(500).selectExpr("if(id % 3 = 0, 'a', 'b') AS s", "double(id * id % 97) AS v")
    one, more = S.ks_wasserstein(ks, "v", "s", "a", "b", 1).first(), S.ks_wasserstein(ks, "v", "s", "a", "b", 16).first()
    assert more[:] == pytest.approx(one[:]) and one.ks > 0
    lines = frame(spark, [("a" * n,) for n in (1, 7, 12, 56, 90)], "line string")
    assert rows(S.length_histogram(lines, "sparse"), "bin", "n") == [(0, 1), (10, 1), (5, 1), (55, 2)]
    assert len(rows(S.length_histogram(lines, "fixed"), "bin")) == 11 and len(rows(S.length_histogram(lines, "open"), "bin")) == 19
    want = frame(spark, [("a", "required"), ("z", "required"), ("b", "excluded")], "p string, class string")
    assert rows(S.mix_gaps({"observed": df}, "p", want), "p", "reason") == [("a", None), ("b", "excluded_present"), ("z", "required_missing_in_observed")]


def test_order_operators(spark):
    seg = frame(spark, [(1, 0, 0, None, "a"), (1, 1, 0, "space", "b"), (1, 2, 0, "cell", "c"), (1, 3, 1, None, "d"), (1, 4, 1, None, "e")], "page int, i int, l int, j string, t string")
    assert rows(W.reconstruct(seg, ["page"], "i", "l", "j", "t"), "l", "line", "ok") == [(0, "a b | c", True), (1, "d e", False)]
    bad = frame(spark, [(1, 0, 0), (1, 2, 1), (1, 3, 0)], "page int, i int, l int")
    assert rows(W.order_violations(bad, ["page"], "i", "l"), "i", "rule") == [(2, "position"), (3, "position")]
    lines = frame(spark, [(1, None, 0), (1, 5, 1), (1, 2, 2)], "page int, idx int, d int")
    assert rows(W.reading_order(lines, ["page"], "idx", "d"), "d", "pos") == [(0, 2), (1, 1), (2, 0)]
    keys = spark.range(100).selectExpr("cast(id AS string) AS k")
    counts = [r["count"] for r in W.balanced_assignment(keys, "k", ["a", "b", "c"], 1).groupBy("assigned").count().collect()]
    assert max(counts) - min(counts) <= 1
    g = spark.range(100).selectExpr("id", "id % 4 AS g")
    assert [r["count"] for r in W.capped_sample(g, ["g"], "id", 5, 1).groupBy("g").count().collect()] == [5] * 4
    assert W.keep_first(g, "g", "id", 2, 3).count() == 3 and W.keep_first(g, "g", "id", 2).count() == 4
    mixed = W.interleave(spark.range(8).selectExpr("id"), spark.range(100, 103).selectExpr("id"), "id", "id", 4).orderBy("slot").collect()
    assert [r.slot for r in mixed] == list(range(11)) and [r.id for r in mixed if r.id < 100] == list(range(8))
    sizes = frame(spark, [(1, i, s) for i, s in enumerate([2, 6, 2, 2, 6, 3])] + [(2, 0, 9), (None, 5, 2)], "page int, i int, s int")
    assert rows(W.page_pack(sizes, ["page"], "i", F.col("s")), "page", "i", "paragraph") == sorted([(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2), (2, 0, 0), (None, 5, 0)], key=str)
    regions = frame(spark, [(1, "r1", 3, True), (1, "r2", 0, False), (1, "r3", 5, True)], "page int, r string, pos int, sc boolean")
    assert rows(W.region_index(regions, ["page"], "r", "pos", "sc"), "r", "region_index", "reading_order_index") == [("r1", 1, 0), ("r2", 0, None), ("r3", 2, 1)]
    assert spark.range(5).select(W.round_robin(F.col("id"), ["x", "y"])).collect()[3][0] == "y"


def manifest():
    page = lambda i, sha="a" * 64: {"page_id": f"p{i}", "asset_path": f"pages/p{i}.jpg", "media_type": "image/jpeg", "sha256": sha, "width": 10, "height": 20}
    sample = lambda i, text: {"sample_id": f"x-s00000017-{i:06d}", "pages": [page(i)], "text": {"logical_order": text}, "recipe_id": "r", "provenance": {"template_id": "t", "recipe_id": "r", "seed": 17, "sample_index": i}, "controls": {"persona": "" if i else "old"}}
    return {"manifest_version": "1.0", "samples": [sample(0, "one"), sample(1, "two"), sample(2, "two")]}


def test_manifests_flatten_and_findings_follow(spark, tmp_path):
    (tmp_path / "b1").mkdir()
    (tmp_path / "b1/generation_manifest.json").write_text(json.dumps(manifest()))
    pages = batch.flatten_manifest(R.read_manifests(spark, str(tmp_path / "*/generation_manifest.json")))
    assert rows(pages, "sample_pos", "persona", "asset_path") == [(0, "old", "b1/pages/p0.jpg"), (1, "default", "b1/pages/p1.jpg"), (2, "default", "b1/pages/p2.jpg")]
    assert batch.first_pages(pages).count() == 3
    seen = pages.withColumn("actual_sha256", F.when(F.col("sample_pos") == 2, "b" * 64).otherwise(F.col("sha256"))).withColumn("ink_density", F.when(F.col("sample_pos") == 0, 0.001).otherwise(0.5))
    inv = frame(spark, [("b1/pages/p0.jpg", "a" * 64), ("b1/pages/p1.jpg", "c" * 64), ("b1/other", "a" * 64)], "path string, digest string")
    found = batch.page_findings(seen, inv, frame(spark, [("t", "r")], "template_id string, recipe_id string"))
    codes = {r.code: r.severity for r in found.collect()}
    assert codes == {"near_blank_image": "P1", "checksum_inventory_mismatch": "P0", "checksum_inventory_missing_asset": "P0", "manifest_hash_mismatch": "P0", "checksum_inventory_extra_artifact": "P2", "duplicate_text": "P2", "repeated_page_hash": "P2"}
    report = batch.analysis_report(seen, found).first()
    assert (report.page_count, report.sample_count, report.status) == (3, 3, "blocked") and report.duplicate_rate == pytest.approx(0.333333)
    assert batch.aggregate_report(batch.analysis_report(seen, found), None, None).first().review_status == "not_provided"
    assert batch.triage_packet(pages, found.withColumn("batch_id", F.lit("b1")).withColumn("sample_id", F.lit("x")), 2).count() == 2
    checked = pages.withColumn("provenance_recipe_id", F.lit("r"))
    assert bank.manifest_violations(checked, {"template_id": "t"}).count() == 0
    broken = checked.withColumn("text", F.lit("")).withColumn("width", F.lit(0)).withColumn("sha256", F.lit("x")).withColumn("recipe_id", F.lit("q")).withColumn("sample_id", F.lit("s"))
    assert {r.rule for r in bank.manifest_violations(broken, {"template_id": "u"}).collect()} == {"constant_template_id", "recipe", "text_empty", "sha256", "dimensions", "sample_id"}


def test_review_rules_each_once(spark):
    cols = "batch_id string, sample_id string, page_id string, line long, reviewer string, decision string, severity string, reason_codes array<string>, regression_fixture_candidate string"
    good = ("b", "s", "p1", 2, "r", "pass", "", [], "")
    data = [good, ("b", "s", "p1", 3, "r", "pass", "", [], ""), ("b", "s", "zz", 4, "r", "pass", "", [], ""), ("b", "s", "p2", 5, "", "maybe", "P9", ["odd"], "x"), ("b", "s", "p3", 6, "r", "", "", [], ""), ("b", "s", "p4", 7, "r", "hold", "", [], "")]
    pages = frame(spark, [("b", "s", f"p{i}") for i in range(1, 6)], "batch_id string, sample_id string, page_id string")
    got = rows(batch.validate_reviews(frame(spark, data, cols), pages), "code", "page_id")
    assert got == sorted([("duplicate_page_row", "p1"), ("unknown_page_id", "zz"), ("unknown_decision", "p2"), ("missing_reviewer", "p2"), ("unknown_severity", "p2"), ("unknown_reason_code", "p2"), ("invalid_regression_fixture_value", "p2"), ("reviewer_without_decision", "p3"), ("missing_severity", "p4"), ("missing_reason_codes", "p4"), ("missing_page_row", "p5")], key=str)
    counts = {(r.field, r.value): r.n for r in batch.review_counts(frame(spark, data, cols)).collect()}
    assert counts[("decision", "pass")] == 3 and counts[("severity", "P0")] == 0 and len(counts) == 23


def test_joins_and_paths(spark):
    a, b = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(2,), (3,)], "k int")
    assert rows(batch.reconcile(a, b, ["k"]), "k", "status") == [(1, "missing"), (2, "both"), (3, "extra")]
    assert rows(batch.keyed_mismatches(frame(spark, [(2,), (2,), (9,)], "k int"), a, ["k"]), "k", "problem") == [(1, "missing"), (2, "duplicate"), (9, "unknown")]
    left, right = frame(spark, [(0, "x"), (1, "y")], "i int, k string"), frame(spark, [(0, "x"), (1, "z"), (2, "w")], "i int, k string")
    assert rows(batch.positional_mismatches(left, right, "i", ["k"]), "i") == [(1,), (2,)]
    paths = frame(spark, [(p,) for p in ("a/b", "/a", "a/../b", "a\\b", "C:/x", "a b", "a//b", "./a")], "p string").select("p", batch.safe_path(F.col("p")).alias("s"), batch.bank_path(F.col("p")).alias("b"), batch.ascii_path(F.col("p")).alias("x"), batch.canonical_path(F.col("p")).alias("c"))
    got = {r.p: (r.s, r.b, r.x, r.c) for r in paths.collect()}
    assert got["a/b"] == (True,) * 4 and got["/a"] == (False,) * 4 and got["C:/x"][:2] == (True, False) and got["a b"] == (True, True, False, True) and got["a//b"][3] is False and got["./a"][3] is False
    boxes = frame(spark, [(1, "l1", [0, 0, 300, 300]), (1, "l2", [500, 500, 510, 510])], "page int, l string, a array<int>")
    marks = frame(spark, [(1, "m1", [290, 290, 600, 300]), (1, "m2", [300, 0, 310, 10])], "page int, m string, b array<int>")
    assert rows(batch.box_overlaps(boxes, marks, ["page"], "a", "b"), "l", "m") == [("l1", "m1")]
    occ = batch.occluded(boxes, frame(spark, [(1, "l1", [0, 0], [9, 9]), (1, None, [499, 505], [520, 505])], "page int, o string, p array<int>, q array<int>"), ["page"], "l", "a", "o", "p", "q")
    assert rows(occ, "l") == [("l2",)]
    m = batch.provenance_mismatches(frame(spark, [("t", "f1"), ("u", "f")], "t string, font string"), frame(spark, [("t", "f2")], "t string, font string"), "t", ["font"])
    assert rows(m, "t", "column") == [("t", "font"), ("u", "template")]


def test_bank_rules(spark):
    styles = frame(spark, [("s1", "CC0", None, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 2), ("s2", "CC-BY-4.0", None, [3.0, 2.0, 1.0], [1.0, 2.0, 3.0], 5)], "style_id string, licence string, attribution string, letter_gap_px array<double>, word_gap_px array<double>, glyph_count int")
    glyphs = frame(spark, [("g1", "s1", "a", "x/a.png", "x/m.png", [10, 10], [0, 0, 10, 10], 0.5), ("g1", "s1", "ab", "C:/a", "x/m.png", [10, 10], [0, 0, 11, 10], 1.5), ("g2", "zz", "a", "x/a.png", "../m", [10, 10], [0, 0, 9, 9], 0.5)], "glyph_id string, style_id string, char string, asset_path string, mask_path string, size array<int>, ink_box array<int>, score double")
    got = {(r.id, r.rule) for r in bank.bank_violations(styles, glyphs).collect()}
    assert got == {("s2", "attribution"), ("s2", "letter_gap_order"), ("s2", "glyph_count"), ("g1", "duplicate_glyph"), ("g1", "character"), ("g1", "asset_path"), ("g1", "ink_box"), ("g1", "score"), ("g2", "unknown_style"), ("g2", "mask_path")}
    v = frame(spark, [("k", x) for x in (1.0, 1.0, 1.1, 0.9, 1.0, 5.0)] + [("j", 1.0), ("j", 9.0)], "g string, v double")
    assert bank.drop_outliers(v, ["g"], "v").count() == 7
    w = bank.style_weights(frame(spark, [("a",)] * 10 + [("b",)] * 2 + [("c",)], "style_id string"))
    assert rows(w, "style_id", "weight") == [("a", 6.0), ("b", 2.0), ("c", 1.0)]
    missing = frame(spark, [(0, ["x", "y"]), (1, ["y", "x"]), (2, ["z"])], "line_no int, missing array<string>")
    assert [r.char for r in bank.missing_characters(missing, 2).collect()] == ["x", "y"]
    gold = bank.line_gold_mismatches(frame(spark, [(1, "abc")], "k int, t string"), frame(spark, [(1, 0, "a"), (1, 1, "x")], "k int, i int, c string"), ["k"], "t", "c")
    assert rows(gold, "i") == [(1,), (2,)]


def test_annotation_rules(spark):
    schema = "page int, line_index int, logical_line_index int, logical_join string, region string, text string, polygon array<array<int>>, baseline array<array<int>>, width int, height int"
    box = [[0, 0], [9, 0], [9, 9], [0, 9]]
    ok = (1, 0, 0, None, "body", "ab", box, [[0, 9], [9, 9]], 10, 10)
    lines = frame(spark, [ok, (1, 1, 0, None, "body", " x", [[0, 0], [99, 0], [9, 9]], [[9, 9], [0, 9]], 10, 10), (1, 3, 1, "space", "title", "e\u0301\u200f", box, [[0, 9], [9, 9]], 10, 10)], schema)
    got = {(r.line_index, r.rule) for r in bank.line_violations(lines, ["page"]).collect()}
    assert got == {(1, "join_missing"), (1, "trim"), (1, "out_of_page"), (1, "baseline_direction"), (3, "position"), (3, "join_first"), (3, "normal_form"), (3, "control_character")}
    regions = frame(spark, [(1, 0, "body", [[0, 0], [20, 0], [20, 20], [0, 20]], [0, 3]), (1, 2, "body", box, [1, 0, 7])], "page int, region_index int, type string, polygon array<array<int>>, line_indices array<int>")
    got = {(r.region_index, r.rule) for r in bank.region_violations(regions, lines, ["page"]).collect()}
    assert {(0, "type"), (0, "several_owners"), (2, "position"), (2, "members_rising"), (2, "unknown_line"), (2, "containment")} <= got


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes("a \r\n\n b\n".encode())
    assert rows(R.read_lines(spark, str(tmp_path / "c.txt")), "line_no", "line") == [(0, "a"), (1, "b")]
    assert [r.line for r in R.read_lines(spark, str(tmp_path / "c.txt"), strict=True).orderBy("line_no").collect()] == ["a \r", "", " b"]
    (tmp_path / "r.jsonl").write_text('{"id": "1", "text": "x"}\n{"id": "2"}\nnot json\n')
    good, bad = R.read_records(spark, str(tmp_path / "r.jsonl"), ["id", "text"], ["group"])
    assert rows(good, "id") == [("1",)] and rows(bad, "reason") == [("missing_text",), ("not_json",)]
    inv, counts = R.parse_checksums(frame(spark, [(0, "a" * 64 + "  x"), (1, "b" * 64 + "  x"), (2, "zz  y"), (3, "c" * 64 + "  ../z")], "line_no int, value string"))
    assert rows(inv, "path", "digest") == [("x", "b" * 64)] and counts.first()[:] == (1, 1, 1)
    header = ",".join(batch.REVIEW_FIELDS)
    (tmp_path / "w.csv").write_text(header + "\n" + "b,s,p,t,r,,,,,a, me ,hold,P1,text_clipped;text_overlap,,\n")
    r = R.read_reviews(spark, str(tmp_path / "w.csv")).first()
    assert (r.line, r.reviewer, r.reason_codes) == (2, "me", ["text_clipped", "text_overlap"])
    (tmp_path / "w.jsonl").write_text('{"page_id": "p", "reason_codes": ["a", "b"], "regression_fixture_candidate": true}\n{bad\n')
    got = R.read_reviews(spark, str(tmp_path / "w.jsonl")).orderBy("line").collect()
    assert got[0].reason_codes == ["a", "b"] and got[0].regression_fixture_candidate == "true" and got[1].parse_error == "invalid_jsonl_row"
    (tmp_path / "f.yaml").write_text("fonts:\n  - id: a\n    file: 'x.ttf'\n  - id: b\n")
    assert rows(R.read_registry(spark, str(tmp_path / "f.yaml")), "item", "key", "value") == [(1, "file", "x.ttf"), (1, "id", "a"), (2, "id", "b")]
    hashes = R.file_hashes(spark, str(tmp_path / "c.txt"))
    R.write_checksums(hashes, str(tmp_path / "sums"))
    assert R.read_checksums(spark, str(tmp_path / "sums"))[1].first().malformed == 0
    out = str(tmp_path / "pub")
    assert R.publish(spark, lambda p: hashes.write.parquet(p), out)["status"] == "published" and R.publish(spark, lambda p: None, out)["status"] == "failed"
    assert "<td>1</td>" in R.html_report("t", ["a"], [(1,)]) and "| 1 |" in R.markdown_report("t", ["a"], [(1,)])
    assert json.loads(frame(spark, [(1, None)], "b int, a string").select(R.sorted_json(frame(spark, [], "b int, a string"))).first()[0]) == {"a": None, "b": 1}


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_error_rates_cover_whole_texts_of_every_script(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    texts = [("en", "a" * 300 + " LATE WORDS\n\nSecond Line"), ("fr", "Été À l'Île\n" + "é" * 250 + "É"), ("tr", "İstanbul AİA"), ("el", "ΟΔΟΣ Σ\nΣΟΦΟΣ"), ("en", None), ("zz", "𐐀 x𐐀\t日本A")]
    spark.createDataFrame(texts, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.lang: (r.chars, r.edits) for r in QUERIES["stratified_cer_all"](spark, str(tmp_path)).collect()}
    low = {t: spark.createDataFrame([(t,)], "t string").select(F.lower("t")).first()[0] for _, x in texts for t in (x or "").split("\n")}
    want = {}
    for lang, text in texts:
        for line in (text or "").split("\n"):
            if line:
                ref, hyp = line.replace(" ", ""), low[line].replace(" ", "")
                chars, edits = want.get(lang, (0, 0))
                want[lang] = (chars + len(ref), edits + brute_distance(ref, hyp))
    assert got == want and got["en"][1] == 11 and set(got) == {"en", "fr", "tr", "el", "zz"}


def test_edit_distance_equals_brute_force(spark):
    import random

    r = random.Random(8)
    pairs = [("".join(r.choices("abAé😀", k=r.randint(0, 7))), "".join(r.choices("abAé😀", k=r.randint(0, 7)))) for _ in range(300)]
    got = frame(spark, pairs, "a string, b string").select("a", "b", S.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == brute_distance(x.a, x.b) for x in got)


def test_all_file_rules_and_mark_classes_come_out(spark, tmp_path):
    from corpusloom.functions import classes as C
    from corpusloom.plans.registry import QUERIES

    texts = ["\ufeffa\n", "a\n\nb\n", "a\n b\n", "a\r\n", "a", "a  b\n", "a\tb\n", "fine\n", "\u05d0\u05f3\n", "\u05d0\u05d1\u05f3\n"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    faults = dict(rows(QUERIES["hygiene_faults_all"](spark, str(tmp_path)), "rule", "n"))
    assert set(faults) == {"bom", "carriage_return", "no_final_line_feed", "blank_line", "padding", "double_space", "tab"}
    assert faults["bom"] == faults["no_final_line_feed"] == faults["double_space"] == faults["tab"] == 1
    marks = dict(rows(QUERIES["mark_class_lines_all"](spark, str(tmp_path)), "class", "n"))
    assert set(marks) == set(C.MARK_CLASSES) and marks["geresh_letter_numeral"] == 1 and marks["geresh_after_letter"] == 2
