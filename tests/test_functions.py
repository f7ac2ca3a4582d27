"""Scalar functions and classes on literal fixtures."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import classes as C
from corpusloom.functions import geometry as G
from corpusloom.functions import numbers as N
from corpusloom.functions import text as T
from corpusloom.functions import udfs as U


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr(F.col("x"))).orderBy("i").collect()]


def test_spaces_split_as_python_does(spark):
    cases = ["a b c", "a\x1cb", "a b", "", "  \t ", " a  b ", "x\x85y"]
    assert column(spark, cases, T.tokens) == [c.split() for c in cases]
    assert column(spark, cases, T.collapse) == [" ".join(c.split()) for c in cases]
    cases = ["a\nb\r\nc\x0bd\x1ce f", " x \n\n y", ""]
    assert column(spark, cases, T.lines_stripped) == [[s.strip() for s in c.splitlines() if s.strip()] for c in cases]
    assert column(spark, ["a\n b \n", "a\nb", ""], T.lines_strict) == [["a", " b "], ["a"], []]


def test_ngrams_hashes_and_folds(spark):
    assert column(spark, ["a b c d", "a b", ""], lambda x: T.word_ngrams(T.tokens(x), 3)) == [["a b c", "b c d"], [], []]
    assert column(spark, ["abcdef", "abcd"], lambda x: T.char_ngrams(x, 5)) == [["abcde", "bcdef"], []]
    assert column(spark, ["ab12-c3"], T.skeleton) == ["a0-a0"]
    assert column(spark, ["א״ב „x” –"], T.fold_label) == ['א"ב "x" -']
    assert column(spark, ["5", "true", "1.5", None], T.optional_int) == [5, None, None, None]
    assert column(spark, [["a", "0", "b"]], T.json_location, "array<string>") == ["$.a[0].b"]
    assert column(spark, [["ab", "c", "def"]], lambda x: T.join_tokens(x)["starts"], "array<string>") == [[0, 3, 5]]
    assert column(spark, [["aa", "bb", "ccccc", "d"]], lambda x: T.wrap_chars(x, 5), "array<string>") == [["aa bb", "ccccc", "d"]]
    seed = column(spark, ["k"], lambda x: T.hash_seed(17, x))[0]
    import hashlib

    assert int(seed) == int(hashlib.sha256(b"17:k").hexdigest()[:16], 16)
    assert column(spark, ["abc", "a c"], lambda x: T.cer(x, F.lit("abd"))) == [pytest.approx(1 / 3), 1.0]


def test_numbers(spark):
    assert column(spark, ["12", "3.4", "1,000", "5%", "1/2", "1.2.3", "1.2.2020", "1234567"], N.number_shape) == ["int_len2", "decimal_or_section", "thousands", "percent", "slash_ref", "section_multi", "date", "int_len6+"]
    assert column(spark, ["a 1.5, 20% and 3/4."], N.number_tokens) == [["1.5", "20%", "3/4"]]
    assert column(spark, ["000000018", "123456782", "12345", "x"], N.check_digit_valid) == [True, True, False, False]
    assert column(spark, [1, 15, 16, 115, 499, 999, 1000], N.hebrew_numeral, "int") == ["א", "טו", "טז", "קטו", "תצט", "תתקצט", None]
    assert column(spark, [1, 15, 499, 500], N.hebrew_numeral_marked, "int") == ["א'", 'ט"ו', 'תצ"ט', None]
    assert column(spark, ["31.2", "2.31", "13.2", "31.2"], lambda x: N.reordered(F.lit("31.2"), x)) == [False, True, False, False]


# invented strings
CONTEXT = [
    ("8.25", "rule 25.8 applies", "reversed_groups_no_space"),
    ("40/7", "7,40", "reversed_groups_no_space"),
    ("8.25", "25 . 8", "reversed_groups_with_space"),
    ("8.25", "25. ,8", "reversed_groups_with_space"),
    ("8.25", "is 8 25 long", "same_order_with_space"),
    ("8.25", "8. /25", "same_order_with_space"),
    ("6.5.44", "6544", "separators_dropped"),
    ("6.5.44", "it is 4456", "separators_dropped"),
    ("6.5.44", "6/5,44", "same_order_sep_changed_or_doubled"),
    ("6.5.44", "6,/5..44", "same_order_sep_changed_or_doubled"),
    ("6.5.44", "5 of 44, then 6", "groups_scattered"),
    ("6.5.44", "44 pages", "some_groups_only"),
    ("6.5.44", "5 pages", "no_group"),
    ("6.5.44", "6.5.44.9", "no_group"),
]


def test_number_context(spark):
    df = spark.createDataFrame(CONTEXT, "t string, r string, want string")
    assert [(r.got, r.want) for r in df.select(U.number_context_class("t", "r").alias("got"), "want").collect()] == [(w, w) for *_, w in CONTEXT]


def test_normal_form_and_levels(spark):
    cases = ["é", "é", "abc", "שׁ", None]
    assert column(spark, cases, U.is_nfc) == [None if c is None else unicodedata.is_normalized("NFC", c) for c in cases]
    text = ["אב 12 ג", "אב abc ג", "א a b", "א (a) ב", "א 1.5 ב", "א 5% ב"]
    got = column(spark, text, U.bidi_levels)
    assert got[0] == [1, 1, 1, 2, 2, 1, 1] and got[1] == [1, 1, 1, 2, 2, 2, 1, 1] and got[2] is None
    assert got[4] == [1, 1, 2, 2, 2, 1, 1] and got[5] == [1, 1, 2, 2, 1, 1]
    assert column(spark, [[1, 2, 2, 1]], U.rtl_order, "array<int>") == [[0, 2, 1, 3]]
    assert column(spark, ['{"a": ["x", {"b": "y"}], "c": 1}', "no"], U.json_strings) == [["x", "y"], None]
    assert column(spark, [[1, 2, 2, 1, 2]], U.section_labels, "array<int>") == [["1", "1.1", "1.2", "2", "2.1"]]
    df = spark.createDataFrame([(3, k) for k in ("label", "date", "short_int", "amount", "percent")], "s long, k string")
    assert all(r[0] for r in df.select(U.generated_number("s", "k")).collect())


HITS = {
    "latin_word": ("the word", "AB 1"), "acronym": ("an ABC x", "Abc"), "latin_run_2plus": ("one two", "one"), "latin_run_3plus": ("one two three", "one two"), "alphanumeric_code": ("A1-b2", "abc"),
    "date_slash": ("1/2/2020", "1/2/20201"), "date_dot": ("1.2.20", "1.2.3.4"), "date_iso": ("2020-01-02", "12020-01-02"), "date_month_year": ("03/2020", "13/2020"), "date_latin_month": ("Jan 2020", "Janus"),
    "quarter_or_half": ("Q3", "Q5"), "time_of_day": ("23:59", "24:00"), "number_with_unit": ("5 kg", "5 kgx"), "percent": ("5%", "5 %"), "shekel_sign": ("₪", "$"), "nis": ("NIS 5", "NISX"), "shekel_abbreviation": ('ש"ח', "שח"),
    "foreign_currency": ("USD", "USDX"), "email": ("a@b.test", "a@b.com"), "url_or_domain": ("www.a.test", "a.com"), "parenthesised_latin": ("(ab)", "(א)"), "parenthesised_hebrew": ("(אב)", "(ab)"), "version_string": ("v1.2", "v1"),
    "section_number": ("סעיף 3.1", "סעיף א"), "grouped_number": ("1,000", "1,00"), "hyphenated_prefix": ("ב-5", "ב 5"), "slash": ("a/b", "ab"), "colon": ("a:b", "ab"), "ascii_double_quote": ('"', "'"),
    "gershayim_in_word": ('א"ב', 'א"'), "geresh_after_letter": ("א'", "'א"), "digits_no_latin": ("א 1", "a 1"), "plain_hebrew": ("אב", "אב1"), "latin_any": ("a", "1"), "latin_at_start": ("(a", "א a"), "latin_at_end": ("א ab.", "ab א"),
    "latin_in_middle": ("א abc d ב", "א ב"), "date_hebrew_month": ("5 במאי 2020", "מאי"),
}


def test_every_token_class_hits_and_misses(spark):
    assert set(HITS) == set(C.TOKEN_CLASSES)
    for name, (hit, miss) in HITS.items():
        assert column(spark, [hit, miss], lambda x, n=name: C.has_class(x, n)) == [True, False], name


def test_units_runs_and_domains(spark):
    has = lambda name, *lines: column(spark, list(lines), lambda x: C.has_class(x, name))
    assert has("number_with_unit", "5 מטר", '3 ק"מ', "2 kVA", "4 יח'", "7 mg", "8 px") == [True, True, True, True, False, False]
    assert has("latin_run_2plus", "a/b c", "one/two", "R&D team") == [True, False, True]
    domains = column(spark, ["see www.real.org now", "real.co.il", "ok.test", "www.example.org", "a.b.example.com x", "see real.shop"], C.privacy_hits)
    assert ["open_domain" in d for d in domains] == [True, True, False, False, False, False]
    assert column(spark, ["a Xerox copy", "saps"], C.privacy_hits) == [["brand"], []]


def test_class_counts_equal_plain_patterns(spark):
    from corpusloom.operators.corpus_stats import class_lines

    lines = spark.createDataFrame([(x,) for pair in HITS.values() for x in pair], "line string")
    got = {r["class"]: r.n for r in class_lines(lines).collect()}
    want = lines.agg(*[F.count_if(F.col("line").rlike(p)).alias(n) for n, p in C.TOKEN_CLASSES.items()]).first().asDict()
    assert got == want


def test_marks_features_privacy_and_hygiene(spark):
    marks = {"gershayim_in_word": "א״ב", "geresh_letter_numeral": "א׳", "geresh_foreign_sound": "ג׳ו", "em_dash": "—", "en_dash_range": "1–2", "en_dash_spaced": "a – b", "double_quotes": "“a”", "low_double_quotes": "„a”", "single_quotes": "‘a’", "ellipsis": "…", "semicolon": ";"}
    for n, hit in marks.items():
        assert column(spark, [hit, "x"], lambda x, n=n: C.has_class(x, n, C.MARK_CLASSES)) == [True, False], n
    assert column(spark, ["a; b — c", "a"], C.mark_kind_count) == [2, 0]
    assert set(column(spark, ["שלום, 5 abc AB-12 1/2/2020"], C.text_features)[0]) == {"final_forms", "punctuation", "numerals", "dates", "identifiers", "latin_fragments", "nfc_logical_order_text"}
    assert column(spark, ["א a", "א 1", "a 1"], C.bidi_features) == [["hebrew_latin_fragments"], ["hebrew_numeric_fragments"], []]
    assert column(spark, ["(a[b])", "(a]", "a)"], C.balanced) == [True, False, False]
    privacy = column(spark, ["a@example.com", "a@real.org", "call 1234567", "id 123456782", "12-345-6789", "new iPhone", "fine 12"], C.privacy_hits)
    assert privacy == [["email"], ["email", "open_domain"], ["long_digit_run"], ["long_digit_run", "identity_number"], ["joined_digits"], ["brand"], []]
    assert column(spark, ["a\nb\n", "﻿a\r\n\n b  c\t"], C.hygiene_faults) == [[], ["bom", "carriage_return", "no_final_line_feed", "blank_line", "padding", "double_space", "tab"]]
    assert column(spark, ["סםא", "שלום מלך", "א — ב"], C.orthography_faults)[0] == ["medial_final_form"]
    assert column(spark, ["a1ב"], lambda x: C.outside_allowed(x, "a-z")) == [["1", "ב"]]


def test_geometry(spark):
    square = F.expr("array(array(0,0),array(10,0),array(10,10),array(0,10))")
    back = F.expr("array(array(0,10),array(10,10),array(10,0),array(0,0))")
    one = lambda e: spark.range(1).select(e).first()[0]
    pts = lambda *p: F.expr("array(" + ",".join(f"array({x},{y})" for x, y in p) + ")")
    for poly in (square, back):
        assert one(G.polygon_contains(poly, pts((5, 5), (0, 0)))) and one(G.polygon_contains(poly, pts((11, 5)))) and not one(G.polygon_contains(poly, pts((12, 5))))
    box = lambda *b: F.array(*map(F.lit, b))
    assert one(G.boxes_overlap(box(0, 0, 2, 2), box(1, 1, 3, 3))) and not one(G.boxes_overlap(box(0, 0, 2, 2), box(2, 0, 3, 3)))
    seg = lambda a, b: one(G.segment_hits_box(box(*a), box(*b), box(2, 2, 4, 4)))
    assert seg((0, 0), (5, 5)) and not seg((0, 0), (1, 5)) and seg((3, 0), (3, 9)) and not seg((5, 0), (5, 9))
    src, dst = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], [[1.0, 2.0], [3.0, 2.5], [4.0, 5.0], [0.5, 4.0]]
    df = spark.createDataFrame([(src, dst)], "s array<array<double>>, d array<array<double>>").withColumn("h", U.homography("s", "d"))
    r = df.select(G.apply_homography(F.col("h"), F.lit([1.0, 1.0])).alias("p"), G.apply_homography(G.invert_homography(F.col("h")), F.lit([4.0, 5.0])).alias("q")).first()
    assert r.p == pytest.approx([4, 5]) and r.q == pytest.approx([1, 1])
    hist = [0] * 256
    hist[10], hist[200] = 3, 1
    df = spark.createDataFrame([(hist,)], "h array<long>")
    assert df.select(G.ink_density(F.col("h"))).first()[0] == 0.75 and df.select(G.histogram_percentile(F.col("h"), 0.5)).first()[0] == 10 and 10 <= df.select(G.otsu(F.col("h"))).first()[0] < 200
    p = one(G.rotate(box(1.0, 0.0), F.lit(90.0), F.lit(0.0), F.lit(0.0)))
    assert p == pytest.approx([0, -1], abs=1e-9) and one(G.clamp(box(2.5, -3.0), F.lit(10), F.lit(10))) == [2, 0]
    assert len(one(G.ellipse(box(0, 0, 2, 2), 8))) == 9 and math.isclose(one(G.signed_area(square)), 100)
