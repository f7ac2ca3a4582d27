"""All named queries of the library and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import classes as C
from corpusloom.functions import numbers as N
from corpusloom.functions import text as T
from corpusloom.operators import bank, batch
from corpusloom.operators import corpus_stats as S
from corpusloom.operators import governance as G
from corpusloom.operators import leakage as L
from corpusloom.operators import validation as V
from corpusloom.operators import windows as W
from corpusloom.streaming.events import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions that several statements start from.
LINES = r"""ln AS (SELECT doc_id AS id, lang, source, i AS line_no, trim(l, E' \t') AS line FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(l, E' \t') <> ''),
bl AS (SELECT item_id AS id, trim(l, E' \t') AS line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE trim(l, E' \t') <> '')"""
TOKENS = "list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_lines(read(spark, sf_dir, "documents"), "doc_id", "text")


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_lines(read(spark, sf_dir, "benchmark"), "item_id", "text")


def _grams(table: str, n: int) -> str:
    return f"SELECT DISTINCT array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {TOKENS} AS w FROM {table}) WHERE len(w) >= {n})"


# ---- strata and duplicates ----


@query("reviewed_share", "SELECT lang, count(*) AS total, count(quality) AS reviewed, count(quality) / count(*) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def _(spark, d):
    return S.reviewed_share(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id", ["lang"], "quality")


@query("stratum_counts", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), count(*) / (SELECT count(*) FROM documents) FROM documents GROUP BY source")
def _(spark, d):
    return S.stratum_counts(read(spark, d, "documents"), ["lang", "source"])


@query("cross_stratum_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def _(spark, d):
    return S.cross_counts(read(spark, d, "documents"), "lang", "source")


@query(
    "largest_stratum_share",
    "WITH c AS (SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS k FROM c) SELECT dimension, value, n, n / (SELECT count(*) FROM documents) AS share FROM r WHERE k = 1",
)
def _(spark, d):
    return S.largest_share(read(spark, d, "documents"), ["lang", "source"])


@query("distinct_value_count", "SELECT 'lang' AS dimension, count(DISTINCT lang) AS n FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents")
def _(spark, d):
    return S.distinct_values(read(spark, d, "documents"), ["lang", "source"])


@query(
    "seed_span_summary",
    "WITH k AS (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS g FROM (SELECT DISTINCT lang, doc_id FROM documents)), r AS (SELECT lang, max(n) AS longest_run FROM (SELECT lang, g, count(*) AS n FROM k GROUP BY lang, g) GROUP BY lang) SELECT lang, min(doc_id) AS min_key, max(doc_id) AS max_key, count(DISTINCT doc_id) AS distinct_keys, count(*) AS n, any_value(longest_run) AS longest_run FROM documents JOIN r USING (lang) GROUP BY lang",
)
def _(spark, d):
    return S.span_summary(read(spark, d, "documents"), "doc_id", ["lang"])


@query(
    "stratum_delta",
    "WITH a AS (SELECT lang, count(*) AS n FROM documents WHERE source = 'src0' GROUP BY lang), b AS (SELECT lang, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY lang), j AS (SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS a_n, coalesce(b.n, 0) AS b_n FROM a FULL JOIN b ON a.lang = b.lang) SELECT lang, a_n, b_n, a_n / (SELECT sum(n) FROM a) AS a_share, b_n / (SELECT sum(n) FROM b) AS b_share, a_n / (SELECT sum(n) FROM a) - b_n / (SELECT sum(n) FROM b) AS delta, CASE WHEN a_n = 0 THEN 'a' WHEN b_n = 0 THEN 'b' END AS missing_in FROM j",
)
def _(spark, d):
    docs = read(spark, d, "documents")
    return S.stratum_delta(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "lang")


@query(
    "skew_warnings",
    "WITH m AS (SELECT 'lang_share' AS metric, max(n) / sum(n) AS value FROM (SELECT count(*) AS n FROM documents GROUP BY lang) UNION ALL SELECT 'source_share', max(n) / sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) SELECT metric, value, CASE WHEN value >= 0.6 THEN 'hold' WHEN value >= 0.3 THEN 'warn' ELSE 'ok' END AS level FROM m",
)
def _(spark, d):
    best = S.largest_share(read(spark, d, "documents"), ["lang", "source"])
    metrics = best.select(F.concat("dimension", F.lit("_share")).alias("metric"), F.col("share").alias("value"))
    return S.warning_bands(metrics, [("lang_share", 0.3, 0.6), ("source_share", 0.3, 0.6)])


@query("duplicate_groups", "SELECT sha256(text) AS sha256, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return L.duplicate_groups(read(spark, d, "documents").select(T.sha256(F.col("text")).alias("sha256")), "sha256")


@query("duplicate_rate", "WITH g AS (SELECT count(*) AS c FROM documents GROUP BY text) SELECT count(*) FILTER (c > 1) AS groups, sum(c - 1)::BIGINT AS extra, sum(c)::BIGINT AS rows, round(sum(c - 1) / sum(c), 6) AS rate FROM g")
def _(spark, d):
    return L.duplicate_rate(read(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("seen_before", r"SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) ORDER BY doc_id) > 1 AS seen_before FROM documents")
def _(spark, d):
    return L.duplicate_rows(read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "seen_before")


@query(
    "near_duplicate_pairs",
    r'''WITH t AS (SELECT min(doc_id) AS id, s FROM (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS s FROM documents) WHERE len(s) > 0 GROUP BY s), j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS k, len(a.s) AS x, len(b.s) AS y FROM t a JOIN t b ON a.id < b.id AND len(a.s) * 100 >= len(b.s) * 90 AND len(b.s) * 100 >= len(a.s) * 90) SELECT a, b, k AS "both", x + y - k AS either FROM j WHERE k * 100 >= (x + y - k) * 90''',
)
def _(spark, d):
    return L.near_duplicate_pairs(read(spark, d, "documents"), "doc_id", T.tokens(F.col("text")), 90)


# ---- corpus statistics ----


@query(
    "line_stats",
    f"WITH {LINES}, w AS (SELECT lang, unnest({TOKENS}) AS w FROM ln), v AS (SELECT lang, sum(n)::BIGINT AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapax FROM (SELECT lang, w, count(*) AS n FROM w GROUP BY lang, w) GROUP BY lang), s AS (SELECT lang, count(*) AS lines, sum(length(line))::BIGINT AS characters, min(length(line)) AS min_len, median(length(line)) AS median_len, avg(length(line)) AS mean_len, max(length(line)) AS max_len FROM ln GROUP BY lang) SELECT s.*, tokens, types, hapax, types / tokens AS ttr FROM s JOIN v USING (lang)",
)
def _(spark, d):
    langs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return S.file_stats(doc_lines(spark, d).join(langs, "id"), ["lang"])


@query("char_class_counts", r"WITH c AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(l, '')) AS c FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE c <> '' GROUP BY c) SELECT CASE WHEN c BETWEEN 'א' AND 'ת' THEN 'hebrew_letter' WHEN regexp_matches(c, '^[0-9]$') THEN 'digit' WHEN regexp_matches(c, '^[A-Za-z]$') THEN 'latin' WHEN c = ' ' THEN 'space' ELSE 'punctuation_symbol' END AS class, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def _(spark, d):
    pieces = read(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return S.char_classes(pieces)


@query("letter_frequencies", f"WITH {LINES}, c AS (SELECT unnest(string_split(lower(line), '')) AS c FROM ln) SELECT letter, count(c) AS n FROM (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS letter) LEFT JOIN c ON c = letter WHERE letter <> '' GROUP BY letter")
def _(spark, d):
    return S.letter_frequencies(doc_lines(spark, d), "abcdefghijklmnopqrstuvwxyz")


_HIST = {
    "open": f"WITH {LINES}, h AS (SELECT length(line) // 5 * 5 AS bin, count(*) AS n FROM ln GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(bin) FROM h) + 5, 5)) AS bin) r LEFT JOIN h ON h.bin = r.bin",
    "sparse": f"WITH {LINES} SELECT least(length(line) // 5 * 5, 55) AS bin, count(*) AS n FROM ln GROUP BY 1",
    "fixed": f"WITH {LINES}, h AS (SELECT least(length(line) // 5 * 5, 50) AS bin, count(*) AS n FROM ln GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 55, 5)) AS bin) r LEFT JOIN h ON h.bin = r.bin",
}
for _kind, _sql in _HIST.items():

    def _histogram(spark, d, kind=_kind):
        return S.length_histogram(doc_lines(spark, d), kind)

    query(f"length_histogram_{_kind}", _sql)(_histogram)


@query(
    "top_words",
    f"WITH {LINES}, w AS (SELECT id, line_no, unnest({TOKENS}) AS word, unnest(range(len({TOKENS}))) AS pos FROM ln), c AS (SELECT word, count(*) AS n, min(id * 1000000000000 + line_no * 1000000 + pos) AS f FROM w GROUP BY word ORDER BY n DESC, f LIMIT 20) SELECT word, n FROM c",
)
def _(spark, d):
    return S.top_words(doc_lines(spark, d), 20).select("word", "n")


# ---- the same classes for an engine without look-around: context is consumed instead ----
_H = "א-ת"
_TOKEN_SQL = r"[A-Za-z][A-Za-z0-9&.+-]*"
_HE = "ינואר|פברואר|מרץ|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר"
_EN = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_UNIT_SQL = r"""(GB|TB|MB|KB|GHz|MHz|Hz|Mbps|Gbps|kWh|kW|kVA|W|V|A|mAh|mm|cm|km|m|kg|g|ml|L|inch|lux|dB|bar|מ"ר|מ"ק|ס"מ|מ"מ|ק"ג|ק"מ|קמ"ש|ליטר|מטר|גרם|טון|וואט|יח')"""
_D = r"\p{Nd}"
_TOKEN_TESTS = {
    "latin_any": r"[A-Za-z]",
    "latin_word": r"(^|[^A-Za-z0-9])[A-Za-z][a-z]{2,}($|[^A-Za-z0-9])",
    "acronym": r"(^|[^A-Za-z0-9-])[A-Z]{2,6}s?($|[^A-Za-z0-9])",
    "latin_run_2plus": rf"(^|[^A-Za-z0-9]){_TOKEN_SQL}[),:]? \(?{_TOKEN_SQL}",
    "latin_run_3plus": rf"(^|[^A-Za-z0-9]){_TOKEN_SQL}[),:]? \(?{_TOKEN_SQL}[),:]? \(?{_TOKEN_SQL}",
    "latin_at_start": r"""^[("']?[A-Za-z]""",
    "latin_at_end": r"""[A-Za-z][A-Za-z0-9]*[).,:;!?"']*$""",
    "latin_in_middle": rf"""[{_H}].* \(?["']?[A-Za-z][^ ]* .*[{_H}]""",
    "date_slash": rf"(^|[^{_D}/]){_D}{{1,2}}/{_D}{{1,2}}/({_D}{{4}}|{_D}{{2}})($|[^{_D}/])",
    "date_dot": rf"(^|[^{_D}.]){_D}{{1,2}}\.{_D}{{1,2}}\.({_D}{{4}}|{_D}{{2}})($|[^{_D}.])",
    "date_iso": rf"(^|[^{_D}]){_D}{{4}}-{_D}{{2}}-{_D}{{2}}($|[^{_D}])",
    "date_month_year": rf"(^|[^{_D}/.])(0?[1-9]|1[0-2])[/.]{_D}{{4}}($|[^{_D}/.])",
    "date_hebrew_month": rf"ב?({_HE}) {_D}{{4}}",
    "date_latin_month": rf"({_D}{{1,2}} {_EN} {_D}{{4}}|{_EN} {_D}{{1,2}},? {_D}{{4}}|{_EN} {_D}{{4}})",
    "quarter_or_half": r"(^|[^A-Za-z0-9])[QH][1-4]($|[^A-Za-z0-9])",
    "time_of_day": rf"(^|[^{_D}:])([01]?{_D}|2[0-3]):[0-5]{_D}($|[^{_D}:])",
    "number_with_unit": rf"{_D}([{_D},.]*{_D})? ?{_UNIT_SQL}($|[^A-Za-z{_H}])",
    "percent": rf"{_D}%",
    "shekel_sign": "₪",
    "nis": r"(^|[^A-Za-z])NIS($|[^A-Za-z])",
    "shekel_abbreviation": 'ש"ח',
    "foreign_currency": r"(^|[^A-Za-z])(USD|EUR)($|[^A-Za-z])",
    "email": r"[a-z0-9.-]+@[a-z0-9-]+\.test($|[^A-Za-z])",
    "url_or_domain": r"(^|[^@A-Za-z0-9.-])(https?://)?(www\.)?[a-z0-9-]+\.test",
    "parenthesised_latin": r"\([^()]*[A-Za-z][^()]*\)",
    "parenthesised_hebrew": rf"\([^()A-Za-z]*[{_H}][^()A-Za-z]*\)",
    "version_string": rf"(^|[^A-Za-z0-9])v{_D}+(\.{_D}+)+|גרסה {_D}+|Rev\. ?[A-Z0-9]+|(^|[^A-Za-z])V{_D}+\.{_D}+",
    "section_number": rf"(סעיף|סעיפים|בסעיף|לסעיף|מסעיף|פרק|פריט|תת-סעיף) {_D}+",
    "grouped_number": rf"{_D}{{1,3}}(,{_D}{{3}})+",
    "hyphenated_prefix": rf"[{_H}]-({_D}|[A-Za-z])",
    "slash": "/",
    "colon": ":",
    "ascii_double_quote": '"',
    "gershayim_in_word": rf'[{_H}]"[{_H}]',
    "geresh_after_letter": rf"[{_H}]'",
    "plain_hebrew": r"^[^A-Za-z0-9]*$",
}
_quoted = lambda p: p.replace("'", "''")
_matches = lambda p: f"regexp_matches(line, '{_quoted(p)}')"
_TOKEN_SQL_TESTS = {n: _matches(p) for n, p in _TOKEN_TESTS.items()} | {
    "alphanumeric_code": "len(list_filter(regexp_extract_all(line, '[A-Za-z0-9/-]+'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))) > 0",
    "digits_no_latin": f"{_matches(_D)} AND NOT {_matches('[A-Za-z]')}",
}
_MARK_TESTS = {
    "gershayim_in_word": rf"[{_H}]״[{_H}]", "geresh_after_letter": rf"[{_H}]׳", "geresh_letter_numeral": rf"(^|[^{_H}])[{_H}]׳($|[^{_H}])", "geresh_foreign_sound": rf"[גזצ]׳[{_H}]",
    "em_dash": "—", "en_dash": "–", "en_dash_range": rf"[0-9{_H}׳]–[0-9{_H}]", "en_dash_spaced": " – ", "double_quotes": "“[^”]+”", "low_double_quotes": "„[^”]+”",
    "single_quotes": "‘[^’]+’", "ellipsis": "…", "semicolon": ";", "digits": _D, "latin": "[A-Za-z]",
}


def _count_each(name: str, tests: dict[str, str], table: str) -> str:
    """One scan that counts each test, as rows (name, n)."""
    one = ", ".join(f"count(*) FILTER ({t})" for t in tests.values())
    names = ", ".join(f"'{n}'" for n in tests)
    return f"SELECT unnest([{names}]) AS {name}, unnest([{one}]) AS n FROM {table}"


@query("token_class_lines_all", f"WITH {LINES} " + _count_each("class", _TOKEN_SQL_TESTS, "ln"))
def _(spark, d):
    return S.class_lines(doc_lines(spark, d))


@query("mark_class_lines_all", f"WITH {LINES} " + _count_each("class", {n: _matches(p) for n, p in _MARK_TESTS.items()}, "ln"))
def _(spark, d):
    return S.class_lines(doc_lines(spark, d), C.MARK_CLASSES)


@query("mark_kinds", f"WITH {LINES} SELECT " + " + ".join(f"regexp_matches(line, '{C.MARK_CLASSES[k]}')::INT" for k in C.MARK_KINDS) + " AS kinds, count(*) AS n FROM ln GROUP BY 1")
def _(spark, d):
    return S.mark_kinds(doc_lines(spark, d))


_WORDISH = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_POINTS = "[֑-ׇֽֿׁׂׅׄ]"
_FEATURE_TESTS = {
    "final_forms": "regexp_matches(text, '[ךםןףץ]')",
    "punctuation": r"""regexp_matches(text, '[.,:;!?''"()/-]')""",
    "numerals": rf"regexp_matches(text, '{_D}')",
    "dates": rf"regexp_matches(text, '(^|[^{_WORDISH}]){_D}{{1,2}}/{_D}{{1,2}}/{_D}{{2,4}}($|[^{_WORDISH}])')",
    "identifiers": rf"regexp_matches(text, '(^|[^{_WORDISH}])[A-Za-z]+-[A-Za-z0-9\x{{0590}}-\x{{05ff}}-]*{_D}[A-Za-z0-9\x{{0590}}-\x{{05ff}}-]*($|[^{_WORDISH}])|[\x{{0590}}-\x{{05ff}}]-{_D}{{2,5}}-{_D}{{1,3}}|מספר תיק {_D}+/{_D}+|מזהה \S+')",
    "latin_fragments": "regexp_matches(text, '[A-Za-z]')",
    "sparse_niqqud": f"regexp_matches(text, '{_POINTS}')",
    "fuller_niqqud": rf"len(list_filter(string_split_regex(text, '\s+'), lambda x: len(regexp_extract_all(x, '{_POINTS}')) >= 4)) > 0",
    "nfc_logical_order_text": "nfc_normalize(text) = text",
}


@query("text_features", f"SELECT feature, n FROM ({_count_each('feature', _FEATURE_TESTS, 'documents')}) WHERE n > 0")
def _(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.explode(C.text_features(F.col("text"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


@query("digit_rates", f"WITH {LINES} SELECT count(*) AS lines, count(*) FILTER (regexp_matches(line, '[0-9]')) AS lines_with_digit, sum(length(regexp_replace(line, '[^0-9]', '', 'g'))) * 1000 / sum(length(line)) AS digits_per_1000 FROM ln")
def _(spark, d):
    return S.digit_rates(doc_lines(spark, d))


@query("number_shapes", rf"""WITH n AS (SELECT unnest(regexp_extract_all(text, '[0-9]+(?:[.,/][0-9]+)*%?')) AS t FROM documents) SELECT CASE WHEN t LIKE '%\%' ESCAPE '\' THEN 'percent' WHEN regexp_matches(t, '^[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{2,4}}$') THEN 'date' WHEN contains(t, ',') THEN 'thousands' WHEN regexp_matches(t, '^[0-9]+\.[0-9]+$') THEN 'decimal_or_section' WHEN contains(t, '/') THEN 'slash_ref' WHEN regexp_matches(t, '^[0-9]+(\.[0-9]+){{2,}}$') THEN 'section_multi' WHEN length(t) < 6 THEN 'int_len' || length(t) ELSE 'int_len6+' END AS shape, count(*) AS n FROM n GROUP BY 1""")
def _(spark, d):
    t = read(spark, d, "documents").select(F.explode(N.number_tokens(F.col("text"))).alias("t"))
    return t.groupBy(N.number_shape(F.col("t")).alias("shape")).agg(F.count("*").alias("n"))


_HOST_END = "com|org|net|il|io|co|gov|edu|info|biz|test|example|invalid|ai|app|dev|me|tv|uk|us|eu"
_RUNS = "regexp_extract_all(line, '[0-9]+')"
_NAMES = rf"list_concat(list_concat(regexp_extract_all(line, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]*[A-Za-z0-9])', 1), regexp_extract_all(line, '(?:https?://|www\.)([A-Za-z0-9.-]*[A-Za-z0-9])', 1)), regexp_extract_all(line, '(?i)([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{_HOST_END}))(?:$|[^A-Za-z0-9])', 1))"
_DIGIT_SUM = "list_sum([CASE WHEN lpad(x, 9, '0')[i]::INT * (2 - i % 2) > 9 THEN lpad(x, 9, '0')[i]::INT * (2 - i % 2) - 9 ELSE lpad(x, 9, '0')[i]::INT * (2 - i % 2) END FOR i IN range(1, 10)])"
_PRIVACY_TESTS = {
    "email": "regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]')",
    "url": r"regexp_matches(line, '(https?://|www\.)[A-Za-z0-9.-]*[A-Za-z0-9]')",
    "open_domain": rf"len(list_filter({_NAMES}, lambda x: NOT regexp_matches(regexp_replace(lower(x), '^www\.', ''), '^([a-z0-9-]+\.)*([a-z0-9-]+\.test|example\.(com|org|net))$'))) > 0",
    "long_digit_run": f"len(list_filter({_RUNS}, lambda x: length(x) >= 7)) > 0",
    "identity_number": f"len(list_filter(list_filter({_RUNS}, lambda x: length(x) BETWEEN 5 AND 9), lambda x: {_DIGIT_SUM} % 10 = 0)) > 0",
    "joined_digits": "len(list_filter(regexp_extract_all(line, '[0-9]+(?:[- ][0-9]+)+'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 9)) > 0",
    "brand": "regexp_matches(line, '(?i)(^|[^A-Za-z])(microsoft|windows|excel|outlook|google|gmail|android|apple|iphone|ipad|macos|cisco|dell|lenovo|samsung|intel|nvidia|oracle|sap|ibm|xerox|siemens|philips|bosch|toyota|tesla|amazon|aws|azure|whatsapp|facebook|linkedin|youtube|adobe|autocad|vmware|salesforce)($|[^A-Za-z])')",
}


@query("privacy_hits_all", f"WITH {LINES} " + _count_each("rule", _PRIVACY_TESTS, "ln"))
def _(spark, d):
    return S.rule_counts(doc_lines(spark, d), C.privacy_rules(F.col("line")))


_INNER = "string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1]"
_HYGIENE_TESTS = {
    "bom": "starts_with(text, chr(65279))",
    "carriage_return": "contains(text, chr(13))",
    "no_final_line_feed": "NOT ends_with(text, chr(10))",
    "blank_line": f"len(list_filter({_INNER}, lambda x: trim(x) = '')) > 0",
    "padding": rf"len(list_filter({_INNER}, lambda x: x <> '' AND regexp_matches(x, '^[ \t\n\x0B\f\r]|[ \t\n\x0B\f\r]$'))) > 0",
    "double_space": "contains(text, '  ')",
    "tab": "contains(text, chr(9))",
}


@query("hygiene_faults_all", _count_each("rule", _HYGIENE_TESTS, "documents"))
def _(spark, d):
    return S.rule_counts(read(spark, d, "documents"), C.hygiene_rules(F.col("text")))


# ---- leakage ----


@query(
    "word3_overlap",
    f"WITH {LINES}, t AS ({_grams('bl', 3)}), s AS ({_grams('ln', 3)}) SELECT (SELECT count(*) FROM t) AS target_grams, (SELECT count(*) FROM t WHERE g IN (SELECT g FROM s)) AS shared_grams, (SELECT count(*) FROM t WHERE g IN (SELECT g FROM s)) / (SELECT count(*) FROM t) AS share, (SELECT count(*) FROM (SELECT DISTINCT line FROM bl) WHERE line IN (SELECT line FROM ln)) AS shared_lines",
)
def _(spark, d):
    return L.gram_overlap(doc_lines(spark, d), item_lines(spark, d), 3)


@query(
    "word3_overlap_per_line",
    f"WITH {LINES}, t AS ({_grams('bl', 3)}), s AS ({_grams('ln', 3)}) SELECT (SELECT count(*) FROM t) AS target_grams, (SELECT count(*) FROM t WHERE g IN (SELECT g FROM s)) AS shared_grams, (SELECT count(*) FROM t WHERE g IN (SELECT g FROM s)) / (SELECT count(*) FROM t) AS share, (SELECT count(*) FROM bl WHERE line IN (SELECT line FROM ln)) AS shared_lines",
)
def _(spark, d):
    return L.gram_overlap(doc_lines(spark, d), item_lines(spark, d), 3, normal=True, per_line=True)


def _directed() -> str:
    parts = ["SELECT 'lines' AS measure, (SELECT count(DISTINCT line) FROM bl) AS total, (SELECT count(DISTINCT line) FROM bl WHERE line IN (SELECT line FROM ln)) AS seen"]
    tables = []
    for n in (1, 2, 3):
        for name, src in (("t", "bl"), ("s", "ln")):
            tables.append(f"{name}{n} AS ({_grams(src, n).replace('SELECT DISTINCT', 'SELECT', 1)})")
        parts.append(f"SELECT 'word{n}_types', (SELECT count(DISTINCT g) FROM t{n}), (SELECT count(DISTINCT g) FROM t{n} WHERE g IN (SELECT g FROM s{n}))")
        parts.append(f"SELECT 'word{n}_tokens', (SELECT count(*) FROM t{n}), (SELECT count(*) FROM t{n} WHERE g IN (SELECT g FROM s{n}))")
    for name, src in (("ct", "bl"), ("cs", "ln")):
        tables.append(f"{name} AS (SELECT DISTINCT substr(line, i, 5) AS g FROM (SELECT line, unnest(range(1, length(line) - 3)) AS i FROM {src} WHERE length(line) >= 5))")
    parts.append("SELECT 'char5_types', (SELECT count(*) FROM ct), (SELECT count(*) FROM ct WHERE g IN (SELECT g FROM cs))")
    return f"WITH {LINES}, {', '.join(tables)}, u AS ({' UNION ALL '.join(parts)}) SELECT measure, total, seen, seen / greatest(total, 1) AS share FROM u"


@query("directed_overlap", _directed())
def _(spark, d):
    return L.directed_overlap(doc_lines(spark, d), item_lines(spark, d))


@query("hash_fixture", f"WITH {LINES} SELECT DISTINCT 'line' AS kind, sha256(line) AS sha256 FROM bl UNION SELECT 'word3', sha256(g) FROM ({_grams('bl', 3)})")
def _(spark, d):
    return L.hash_fixture(item_lines(spark, d))


@query("hashed_overlap", f"WITH {LINES}, own AS (SELECT 'line' AS kind, line AS g FROM ln UNION SELECT 'word3', g FROM ({_grams('ln', 3)})), fix AS (SELECT 'line' AS kind, line AS g FROM bl UNION SELECT 'word3', g FROM ({_grams('bl', 3)})) SELECT kind, count(*) AS total, count(*) FILTER ((kind, g) IN (SELECT (kind, g) FROM fix)) AS shared FROM own GROUP BY kind")
def _(spark, d):
    return L.hashed_overlap(doc_lines(spark, d), L.hash_fixture(item_lines(spark, d)))


_SKEL = "regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '[A-Za-z]+', 'a', 'g')"


@query("skeleton_leak", f"WITH {LINES}, t AS (SELECT DISTINCT {_SKEL} AS s FROM bl), o AS (SELECT DISTINCT {_SKEL} AS s FROM ln) SELECT (SELECT count(*) FROM t) AS skeletons, (SELECT count(*) FROM t WHERE s IN (SELECT s FROM o)) AS shared_skeletons, (SELECT count(*) FROM (SELECT DISTINCT unnest(string_split(line, '')) AS c FROM bl) WHERE c <> '' AND c NOT IN (SELECT DISTINCT unnest(string_split(line, '')) FROM ln)) AS unseen_characters")
def _(spark, d):
    return L.skeleton_leak(doc_lines(spark, d), item_lines(spark, d))


@query("opening_repeats", f"WITH {LINES} SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM ln GROUP BY array_to_string(string_split(line, ' ')[1:2], ' '))) AS max_opening, count(DISTINCT {_SKEL}) AS skeletons, count(*) AS lines, (SELECT max(n) FROM (SELECT count(*) AS n FROM ln GROUP BY array_to_string(string_split(line, ' ')[1:2], ' '))) <= 25 AND count(DISTINCT {_SKEL}) / count(*) >= 0.97 AS ok FROM ln")
def _(spark, d):
    return L.template_refill(doc_lines(spark, d))


_LETTERS = r"list_filter(string_split_regex(lower(line), '[^\p{L}]+'), lambda x: x <> '')"
_SIX = lambda t: f"SELECT DISTINCT id, line, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT id, line, w, unnest(range(1, len(w) - 4)) AS i FROM (SELECT id, line, {_LETTERS} AS w FROM {t}) WHERE len(w) >= 6)"


@query("decontaminated_lines", f"WITH {LINES}, b AS ({_SIX('bl')}), k AS (SELECT id, line_no, line, {_LETTERS} AS w FROM ln), h AS (SELECT DISTINCT id, line_no FROM (SELECT id, line_no, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 4)) AS i FROM k WHERE len(w) >= 6)) WHERE g IN (SELECT g FROM b)) SELECT k.id, k.line_no, k.line FROM k LEFT JOIN h USING (id, line_no) WHERE h.id IS NULL")
def _(spark, d):
    return L.decontaminated(doc_lines(spark, d), [("benchmark", item_lines(spark, d))]).select("id", "line_no", "line")


@query("control_hits", f"WITH {LINES}, c AS (SELECT id, line_no, {_LETTERS} AS w FROM ln), g AS (SELECT DISTINCT g FROM ({_SIX('bl')})), h AS (SELECT DISTINCT id, line_no FROM (SELECT id, line_no, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT id, line_no, w, unnest(range(1, len(w) - 4)) AS i FROM c WHERE len(w) >= 6)) WHERE g IN (SELECT g FROM g)) SELECT (SELECT count(*) FROM c) AS lines, (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM c) = (SELECT count(*) FROM h) AS ok")
def _(spark, d):
    return L.control_hits(doc_lines(spark, d), [("benchmark", item_lines(spark, d))])


@query("disjoint_sources", "SELECT line, count(DISTINCT source) AS corpora FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, E' \\t') <> '' GROUP BY line HAVING count(DISTINCT source) > 1")
def _(spark, d):
    rows = read(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    return L.cross_corpus_lines(rows, "source")


@query("multiset_diff", r"WITH t AS (SELECT role, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS token FROM conversations), r AS (SELECT token, count(*) AS r FROM t WHERE role = 'user' GROUP BY token), h AS (SELECT token, count(*) AS h FROM t WHERE role = 'assistant' GROUP BY token) SELECT token, greatest(coalesce(r, 0) - coalesce(h, 0), 0) AS missed, greatest(coalesce(h, 0) - coalesce(r, 0), 0) AS extra, least(coalesce(r, 0), coalesce(h, 0)) AS common FROM r FULL JOIN h USING (token)")
def _(spark, d):
    t = read(spark, d, "conversations").select("role", F.explode(T.tokens(F.col("text"))).alias("token"))
    return L.multiset_difference(t.where("role = 'user'"), t.where("role = 'assistant'"), ["token"])


# ---- order ----


@query("reconstruct_turns", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS line FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = read(spark, d, "conversations").select(F.lit(0).alias("page"), "turn", F.col("conv_id").alias("logical"), F.when(F.row_number().over(W.Window.partitionBy("conv_id").orderBy("turn")) > 1, "space").alias("join"), "text")
    return W.reconstruct(c, ["page"], "turn", "logical", "join", "text").select(F.col("logical").alias("conv_id"), "line")


@query("turn_order_check", "WITH c AS (SELECT conv_id, turn + CASE WHEN hash_k = 0 THEN 1 ELSE 0 END AS idx, (turn * 7) % 5 AS logical FROM (SELECT *, length(text) % 3 AS hash_k FROM conversations)), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx, logical) - 1 AS place, max(logical) OVER (PARTITION BY conv_id ORDER BY idx, logical ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c) SELECT rule, count(*) AS n FROM (SELECT CASE WHEN idx <> place THEN 'position' WHEN logical < seen THEN 'monotone' END AS rule FROM t) WHERE rule IS NOT NULL GROUP BY rule")
def _(spark, d):
    """Turns whose index is moved at fixed rows and whose logical index rises and falls, so that both rules are broken."""
    c = read(spark, d, "conversations").select("conv_id", (F.col("turn") + F.when(F.char_length("text") % 3 == 0, 1).otherwise(0)).alias("idx"), ((F.col("turn") * 7) % 5).alias("logical"))
    return W.order_violations(c, ["conv_id"], "idx", "logical", ["logical"]).groupBy("rule").agg(F.count("*").alias("n"))


@query("first_page_per_sample", "SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    turns = read(spark, d, "conversations").select(F.lit("b").alias("batch_id"), F.col("conv_id").alias("sample_id"), F.col("turn").alias("page_pos"), "role", "text")
    return batch.first_pages(turns).select(F.col("sample_id").alias("conv_id"), "role", "text")


@query("first_appearance", "SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS rank FROM conversations GROUP BY conv_id, role")
def _(spark, d):
    return W.first_appearance(read(spark, d, "conversations"), ["conv_id"], "role", "turn").select("conv_id", "role", "rank")


@query("reading_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY quality IS NULL, quality, doc_id) - 1 AS pos FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return W.reading_order(rows, ["source"], "quality", "doc_id").select("doc_id", "pos")


@query("capped_sample", "WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, source FROM h WHERE k <= 5")
def _(spark, d):
    return W.capped_sample(read(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 5, 7)


@query("keep_first", "WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, lang FROM h WHERE k = 1")
def _(spark, d):
    return W.keep_first(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 3)


@query("balanced_assignment", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('5:' || doc_id), doc_id) - 1 AS k FROM documents) SELECT doc_id, ['a', 'b', 'c'][k % 3 + 1] AS assigned FROM r")
def _(spark, d):
    return W.balanced_assignment(read(spark, d, "documents").select("doc_id"), "doc_id", ["a", "b", "c"], 5)


@query("holdout_split", "SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT < 0.2 * 4294967296 AS held FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.hash_split(F.col("doc_id").cast("string"), 0.2).alias("held"))


@query("hash_seeds", "SELECT doc_id, substr(sha256('17:' || doc_id), 1, 16) AS hex FROM documents")
def _(spark, d):
    seed = T.hash_seed(17, F.col("doc_id").cast("string"))
    return read(spark, d, "documents").select("doc_id", F.lower(F.lpad(F.conv(seed.cast("string"), 10, 16), 16, "0")).alias("hex"))


# ---- fits, integrity, reviews ----


@query("quantile_fit", "SELECT event_type, count(value) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM events WHERE value IS NOT NULL GROUP BY event_type HAVING count(value) >= 3")
def _(spark, d):
    return S.quantile_fit(read(spark, d, "events"), "value", ["event_type"])


@query("ks_wasserstein", "WITH e AS (SELECT round(n_chars / 10) AS x, CASE WHEN source = 'src0' THEN 'a' ELSE 'b' END AS s FROM documents), k AS (SELECT x, count(*) FILTER (s = 'a') AS na, count(*) FILTER (s = 'b') AS nb FROM e GROUP BY x), c AS (SELECT x, sum(na) OVER (ORDER BY x) / (SELECT sum(na) FROM k) AS ca, sum(nb) OVER (ORDER BY x) / (SELECT sum(nb) FROM k) AS cb, lead(x) OVER (ORDER BY x) - x AS dx FROM k) SELECT max(abs(ca - cb)) AS ks, sum(abs(ca - cb) * dx) AS w1 FROM c")
def _(spark, d):
    rows = read(spark, d, "documents").select(F.round(F.col("n_chars") / 10).alias("x"), F.when(F.col("source") == "src0", "a").otherwise("b").alias("s"))
    return S.ks_wasserstein(rows, "x", "s", "a", "b")


@query("ref_integrity", "SELECT 'lineitem' AS child, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    a = batch.orphans(read(spark, d, "lineitem"), read(spark, d, "orders"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("orphans")).select(F.lit("lineitem").alias("child"), "orphans")
    b = batch.orphans(read(spark, d, "orders"), read(spark, d, "customer"), "o_custkey", "c_custkey").agg(F.count("*").alias("orphans")).select(F.lit("orders").alias("child"), "orphans")
    return a.unionByName(b)


@query("count_reconcile", "WITH d AS (SELECT l_orderkey AS k, max(l_linenumber) AS declared, count(*) AS actual FROM lineitem GROUP BY 1) SELECT k AS l_orderkey, declared, actual FROM d WHERE declared <> actual")
def _(spark, d):
    li = read(spark, d, "lineitem")
    return bank.count_mismatches(li.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("n")), li, ["l_orderkey"], "n")


@query("median_outliers", "WITH m AS (SELECT p_brand, median(p_retailprice) AS m, count(*) AS n FROM part GROUP BY p_brand) SELECT p_partkey, p_brand, p_retailprice FROM part JOIN m USING (p_brand) WHERE n < 6 OR p_retailprice / m BETWEEN 0.6 AND 1.6")
def _(spark, d):
    return bank.drop_outliers(read(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_partkey", "p_brand", "p_retailprice")


@query("weight_cap", "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, least(n, 3 * (SELECT median(n) FROM n))::DOUBLE AS weight FROM n")
def _(spark, d):
    return bank.style_weights(read(spark, d, "documents"), "source")


@query("page_assets", "SELECT sha256(html) AS sha256, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256")).groupBy("sha256").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query("reconcile_reviews", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'both' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def _(spark, d):
    return batch.reconcile(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"])


def _worksheet(spark, d):
    """A worksheet derived from labels, with every kind of fault at fixed rows."""
    k = F.col("doc_id")
    row = read(spark, d, "labels").select(
        F.lit("b").alias("batch_id"), F.concat(F.lit("s"), k.cast("string")).alias("sample_id"), F.when(k % 17 == 0, "unknown").otherwise("p0").alias("page_id"), k.alias("line"),
        F.when(k % 5 == 0, "").otherwise("r1").alias("reviewer"), F.when(k % 7 == 0, "maybe").when(k % 3 == 0, "hold").when(k % 11 == 0, "").otherwise("pass").alias("decision"),
        F.when(k % 6 == 0, "P9").when(k % 4 == 0, "P1").otherwise("").alias("severity"),
        F.when(k % 2 == 0, F.array(F.lit("text_clipped"))).when(k % 13 == 0, F.array(F.lit("nonsense"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"),
        F.when(k % 19 == 0, "perhaps").otherwise("").alias("regression_fixture_candidate"),
    )
    pages = read(spark, d, "labels").select(F.lit("b").alias("batch_id"), F.concat(F.lit("s"), k.cast("string")).alias("sample_id"), F.lit("p0").alias("page_id"))
    return row, pages


@query(
    "review_validation",
    """WITH w AS (SELECT doc_id AS k, CASE WHEN doc_id % 17 = 0 THEN 'unknown' ELSE 'p0' END AS page, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'r1' END AS r, CASE WHEN doc_id % 7 = 0 THEN 'maybe' WHEN doc_id % 3 = 0 THEN 'hold' WHEN doc_id % 11 = 0 THEN '' ELSE 'pass' END AS d, CASE WHEN doc_id % 6 = 0 THEN 'P9' WHEN doc_id % 4 = 0 THEN 'P1' ELSE '' END AS s, CASE WHEN doc_id % 2 = 0 THEN 1 WHEN doc_id % 13 = 0 THEN 2 ELSE 0 END AS c, doc_id % 19 = 0 AS f FROM labels),
e AS (SELECT 'unknown_page_id' AS code, count(*) AS n FROM w WHERE page = 'unknown' UNION ALL SELECT 'missing_page_row', count(*) FROM w WHERE page = 'unknown' UNION ALL SELECT 'unknown_decision', count(*) FROM w WHERE d = 'maybe' UNION ALL SELECT 'missing_reviewer', count(*) FROM w WHERE d <> '' AND r = '' UNION ALL SELECT 'reviewer_without_decision', count(*) FROM w WHERE d = '' AND r <> '' UNION ALL SELECT 'unknown_severity', count(*) FROM w WHERE s = 'P9' UNION ALL SELECT 'unknown_reason_code', count(*) FROM w WHERE c = 2 UNION ALL SELECT 'invalid_regression_fixture_value', count(*) FROM w WHERE f UNION ALL SELECT 'missing_severity', count(*) FROM w WHERE d = 'hold' AND s = '' UNION ALL SELECT 'missing_reason_codes', count(*) FROM w WHERE d = 'hold' AND c = 0)
SELECT code, n FROM e WHERE n > 0""",
)
def _(spark, d):
    return batch.validate_reviews(*_worksheet(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


@query("review_counts", """WITH w AS (SELECT doc_id AS k FROM labels), f AS (SELECT 'decision' AS field, CASE WHEN k % 7 = 0 THEN 'maybe' WHEN k % 3 = 0 THEN 'hold' WHEN k % 11 = 0 THEN '' ELSE 'pass' END AS value FROM w UNION ALL SELECT 'severity', CASE WHEN k % 6 = 0 THEN 'P9' WHEN k % 4 = 0 THEN 'P1' ELSE '' END FROM w UNION ALL SELECT 'reason_code', CASE WHEN k % 2 = 0 THEN 'text_clipped' WHEN k % 13 = 0 THEN 'nonsense' END FROM w), dom AS (SELECT 'decision' AS field, unnest(['pass', 'hold', 'reject']) AS value UNION ALL SELECT 'severity', unnest(['P0', 'P1', 'P2', 'info']) UNION ALL SELECT 'reason_code', unnest(['invalid_manifest', 'unsafe_asset_path', 'missing_asset', 'hash_mismatch', 'blank_or_near_blank_page', 'hebrew_not_readable', 'text_clipped', 'text_overlap', 'layout_implausible', 'degradation_obscures_text', 'metadata_image_mismatch', 'catalog_join_problem', 'excessive_repetition', 'style_condition_not_distinct', 'forbidden_claim_risk', 'reviewer_uncertain'])) SELECT dom.field, dom.value, count(f.value) AS n FROM dom LEFT JOIN f ON f.field = dom.field AND f.value = dom.value GROUP BY dom.field, dom.value""")
def _(spark, d):
    return batch.review_counts(_worksheet(spark, d)[0]).select("field", "value", "n")


@query("quality_rollup", "SELECT source, pages, chars, double_spaces, CASE WHEN double_spaces / pages > 0.1 THEN 'double_spaces' ELSE '' END AS over FROM (SELECT source, count(*) AS pages, sum(length(text))::BIGINT AS chars, sum(CASE WHEN contains(text, '  ') THEN 1 ELSE 0 END)::BIGINT AS double_spaces FROM documents GROUP BY ROLLUP (source))")
def _(spark, d):
    rows = read(spark, d, "documents").select("source", F.char_length("text").cast("long").alias("chars"), F.col("text").contains("  ").cast("int").alias("double_spaces"))
    return batch.quality_rollup(rows, "source", ["chars", "double_spaces"], {"double_spaces": 0.1}).withColumn("over", F.array_join("over", ","))


@query("cap_decision", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT source, n, n / (SELECT sum(n) FROM c) AS share FROM c) SELECT source, n, share, CASE WHEN share > 0.3 THEN 'over_cap' ELSE 'within_cap' END AS status, CASE WHEN share > 0.3 THEN 'share_cap' END AS reason FROM t")
def _(spark, d):
    n = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    caps = n.select("source", F.lit(10**9).cast("long").alias("max_n"), F.lit(0.3).alias("max_share"))
    return S.cap_decision(n, "source", caps)


# Lower-casing changes characters in place, and no changed one occurs in the result: each is one edit.
@query("stratified_cer_all", f"WITH {LINES}, p AS (SELECT lang, replace(line, ' ', '') AS r FROM ln) SELECT lang, sum(length(r))::BIGINT AS chars, sum(len(list_filter(string_split(r, ''), lambda c: lower(c) <> c)))::BIGINT AS edits, sum(len(list_filter(string_split(r, ''), lambda c: lower(c) <> c))) / sum(length(r)) AS cer FROM p GROUP BY lang")
def _(spark, d):
    lines = read(spark, d, "documents").select("lang", F.explode(T.lines_stripped(F.col("text"))).alias("ref"))
    return S.stratified_cer(lines.withColumn("hyp", F.lower("ref")), ["lang"], "ref", "hyp").select("lang", F.col("chars").cast("long").alias("chars"), F.col("edits").cast("long").alias("edits"), "cer")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    return windowed_counts(read(spark, d, "events"))


# ---- schemas, findings, bands, gaps and caps ----

_DOC_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["doc_id", "lang"],
    "properties": {
        "doc_id": {"type": "integer", "minimum": 10},
        "lang": {"enum": ["en", "de"]},
        "n_chars": {"type": "integer", "exclusiveMinimum": 100, "maximum": 2000},
        "source": {"type": "string", "minLength": 5, "pattern": "[0-9]$"},
    },
}
_DOC_FAULTS = """SELECT doc_id, '$.doc_id' AS location, 'minimum' AS keyword FROM documents WHERE doc_id < 10
UNION ALL SELECT doc_id, '$.lang', 'enum' FROM documents WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT doc_id, '$.n_chars', 'exclusiveMinimum' FROM documents WHERE n_chars <= 100
UNION ALL SELECT doc_id, '$.n_chars', 'maximum' FROM documents WHERE n_chars > 2000
UNION ALL SELECT doc_id, '$.source', 'minLength' FROM documents WHERE length(source) < 5
UNION ALL SELECT doc_id, '$.source', 'pattern' FROM documents WHERE NOT regexp_matches(source, '[0-9]$')
UNION ALL SELECT doc_id, '$.odd', 'additionalProperties' FROM documents WHERE doc_id % 3 = 0"""


def _doc_json(spark, d):
    docs = read(spark, d, "documents")
    odd = F.when(F.col("doc_id") % 3 == 0, F.lit(1)).alias("odd")
    return docs.select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars", "source", odd)).alias("manifest"))


@query("schema_faults", _DOC_FAULTS)
def _(spark, d):
    return _doc_json(spark, d).select("doc_id", F.inline(V.schema_faults(F.try_parse_json("manifest"), _DOC_SCHEMA)))


@query(
    "validate_batches",
    f"""WITH f AS ({_DOC_FAULTS}), g AS (SELECT doc_id, min(location) AS place, count(*) AS n FROM f GROUP BY 1), e AS (SELECT f.doc_id, any_value(place) AS place, min(keyword) AS k, any_value(n) AS n FROM f JOIN g ON f.doc_id = g.doc_id AND f.location = g.place GROUP BY 1)
SELECT CAST(d.doc_id AS VARCHAR) AS path, d.doc_id % 7 <> 0 AND d.doc_id % 11 <> 0 AND e.n IS NULL AS valid, CASE WHEN d.doc_id % 7 = 0 THEN 'path_missing at $' WHEN d.doc_id % 11 = 0 THEN 'manifest_json_invalid at $' WHEN e.n > 0 THEN 'manifest_schema ' || k || ' at ' || place END AS error,
CASE WHEN d.doc_id % 7 = 0 OR d.doc_id % 11 = 0 THEN 1 ELSE coalesce(e.n, 0) END::BIGINT AS n_errors FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id""",
)
def _(spark, d):
    cut = F.when(F.col("doc_id") % 11 == 0, F.substring("manifest", 1, 5)).otherwise(F.col("manifest"))
    batches = _doc_json(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, "missing").otherwise("folder").alias("kind"), cut.alias("manifest"))
    return V.validate_batches(batches, _DOC_SCHEMA).select("path", "valid", "error", "n_errors")


@query(
    "run_findings",
    """SELECT 'wet_run_not_passed' AS code, 'P0' AS severity, count(*) AS n FROM documents WHERE lang <> 'en' HAVING count(*) > 0
UNION ALL SELECT 'wet_run_report_invalid', 'P0', count(*) FROM documents WHERE doc_id % 5 = 0 HAVING count(*) > 0
UNION ALL SELECT 'wet_run_batch_path_invalid', 'P0', count(*) FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0 HAVING count(*) > 0""",
)
def _(spark, d):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "../").otherwise(""), F.lit("batches/"), F.col("doc_id").cast("string"))
    batch = F.when(F.col("doc_id") % 5 != 0, F.struct(F.col("doc_id").cast("string").alias("batch_id"), path.alias("batch_path"), F.lit("batches/m.json").alias("manifest_path")))
    report = F.to_json(F.struct(F.when(F.col("lang") == "en", "passed").otherwise("failed").alias("status"), batch.alias("generated_batch")))
    return V.run_findings(read(spark, d, "documents").select(report.alias("report"))).groupBy("code", "severity").agg(F.sum("n").alias("n"))


_LEVEL = "CASE WHEN value > {0} THEN 'hold' WHEN value > {1} THEN 'warn' ELSE 'ok' END"


@query(
    "skew_bands",
    f"""WITH s AS (SELECT max(n) / sum(n) AS value FROM (SELECT count(*) AS n FROM documents GROUP BY source)), t AS (SELECT sum(n - 1) / sum(n) AS value FROM (SELECT count(*) AS n FROM documents GROUP BY text)),
r AS (SELECT lang, count(quality) / count(*) AS value, count(quality) AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT 'single_template_dominance' AS pattern, 'source' AS stratum, value, {_LEVEL.format(0.75, 0.5)} AS level FROM s
UNION ALL SELECT 'duplicate_text', 'text', value, {_LEVEL.format(0.2, 0.05)} FROM t
UNION ALL SELECT 'unreviewed_stratum', lang, value, CASE WHEN value > 0 THEN 'ok' ELSE 'hold' END FROM r
UNION ALL SELECT 'style_control_skew', lang, value, CASE WHEN k = 0 THEN 'hold' WHEN k < 5 OR value > 0.8 THEN 'warn' ELSE 'ok' END FROM r""",
)
def _(spark, d):
    docs = read(spark, d, "documents")
    share = lambda pattern, stratum, value, non_default=F.lit(None): (F.lit(pattern).alias("pattern"), stratum.alias("stratum"), value.alias("value"), non_default.cast("long").alias("non_default"))
    top = S.largest_share(docs, ["source"]).select(*share("single_template_dominance", F.lit("source"), F.col("share")))
    rate = docs.groupBy(F.xxhash64("text"), "text").count().agg((F.sum(F.col("count") - 1) / F.sum("count")).alias("v")).select(*share("duplicate_text", F.lit("text"), F.col("v")))
    seen = S.reviewed_share(docs, read(spark, d, "labels"), "doc_id", ["lang"], "quality")
    metrics = top.unionByName(rate).unionByName(seen.select(*share("unreviewed_stratum", F.col("lang"), F.col("share")))).unionByName(seen.select(*share("style_control_skew", F.col("lang"), F.col("share"), F.col("reviewed"))))
    return G.skew_bands(metrics.withColumns({"claimed": F.lit(True), "strict": F.lit(True), "tiny": F.lit(False)}))


@query(
    "profile_gaps",
    """WITH c AS (SELECT source, count(*) AS observed, count(quality) AS reviewed, count(*) FILTER (quality = 1) AS capped, sum(count(*)) OVER () AS t FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT 'source_corpus_skew' AS reason, 'observed' AS layer, source AS stratum, observed AS n FROM c WHERE observed / t > 0.02
UNION ALL SELECT 'cap_conflict', 'observed', source, observed FROM c WHERE observed > 10
UNION ALL SELECT 'unreviewed_requested_stratum', 'reviewed', source, reviewed FROM c WHERE reviewed = 0
UNION ALL SELECT 'missing_stratum', 'capped', source, capped FROM c WHERE capped = 0
UNION ALL SELECT 'utility_evidence_missing', 'profile', NULL, NULL""",
)
def _(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    strata = rows.groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("observed"), F.count("quality").alias("reviewed"), F.count_if(F.col("quality") == 1).alias("capped"))
    fixed = {"dimension": F.lit("source_corpus"), "class": F.lit("required"), "max_share": F.lit(0.02), "max_n": F.lit(10).cast("long"), "is_default": F.lit(False)}
    none = {c: F.lit(None).cast("long") for c in ("least_n", "requested", "released")}
    profile = spark.createDataFrame([("utility_evidence_missing", True), ("seed_concentration", False)], "reason string, broken boolean")
    return G.profile_gaps(strata.withColumns(fixed | none), profile).select("reason", "layer", "stratum", "n")


@query(
    "cap_status",
    """WITH c AS (SELECT lang, count(*) AS n, count(quality) AS reviewed, (SELECT count(*) FROM documents) AS t FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
f AS (SELECT *, n / t AS share, floor(round(0.2 * (t - n) / 0.8, 9))::BIGINT AS fit FROM c)
SELECT lang AS slice, n, share, CASE WHEN reviewed = 0 THEN 0 ELSE least(n, fit, 1000000) END::BIGINT AS admitted, CASE WHEN reviewed = 0 THEN 'hold' WHEN n > fit AND fit = 0 THEN 'reject' WHEN n > fit THEN 'admit_reduced' ELSE 'admit_for_dry_run' END AS status,
CASE WHEN n > fit THEN 'synthetic_percentage_cap_exceeded' ELSE 'within_release_profile_cap' END AS last_reason FROM f""",
)
def _(spark, d):
    n = S.reviewed_share(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id", ["lang"], "quality")
    total = read(spark, d, "documents").agg(F.count("*").alias("t"))
    flags = {c: F.lit(False) for c in G.EVIDENCE} | {"unreviewed": F.col("reviewed") == 0}
    slices = n.crossJoin(F.broadcast(total)).select(F.col("lang").alias("slice"), F.lit("dry_run").alias("purpose"), F.col("total").alias("n"), (F.col("t") - F.col("total")).alias("others"), F.lit(1_000_000).cast("long").alias("max_n"), F.lit(0.2).alias("max_share"), "reviewed").withColumns(flags)
    none = spark.createDataFrame([], "slice string, dimension string, n long, max_n long")
    return G.cap_status(slices, none).select("slice", "n", "share", "admitted", "status", F.element_at("reasons", -1).alias("last_reason"))
