"""Line classes, text features, orthography, hygiene and privacy tests as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.numbers import check_digit_valid
from corpusloom.functions.text import HEBREW, characters, tokens
from corpusloom.functions.udfs import is_nfc

# ---- Fixed values: line token classes (a line counts once for each class that it holds) ----
_H = HEBREW
_LATIN_TOKEN = r"[A-Za-z][A-Za-z0-9&.+-]*"
_MONTHS_HE = "ינואר|פברואר|מרץ|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר"
_MONTHS_EN = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_UNITS = (
    r"(?:GB|TB|MB|KB|GHz|MHz|Hz|Mbps|Gbps|kWh|kW|kVA|W|V|A|mAh|mm|cm|km|m|kg|g|ml|L|inch|lux|dB|bar"
    r'|מ"ר|מ"ק|ס"מ|מ"מ|ק"ג|ק"מ|קמ"ש|ליטר|מטר|גרם|טון|וואט|יח\')'
)
TOKEN_CLASSES = {
    "latin_any": r"[A-Za-z]",
    "latin_word": r"(?<![A-Za-z0-9])[A-Za-z][a-z]{2,}(?![A-Za-z0-9])",
    "acronym": r"(?<![A-Za-z0-9-])[A-Z]{2,6}s?(?![A-Za-z0-9])",
    "latin_run_2plus": rf"(?<![A-Za-z0-9]){_LATIN_TOKEN}[),:]? \(?{_LATIN_TOKEN}",
    "latin_run_3plus": rf"(?<![A-Za-z0-9]){_LATIN_TOKEN}[),:]? \(?{_LATIN_TOKEN}[),:]? \(?{_LATIN_TOKEN}",
    "latin_at_start": r"^[(\"']?[A-Za-z]",
    "latin_at_end": r"[A-Za-z][A-Za-z0-9]*[).,:;!?\"']*$",
    "latin_in_middle": rf"[{_H}].* \(?[\"']?[A-Za-z][^ ]* .*[{_H}]",
    "alphanumeric_code": r"(?<![A-Za-z0-9])(?=[A-Za-z0-9/-]*[A-Za-z])(?=[A-Za-z0-9/-]*\d)[A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*",
    "date_slash": r"(?<![\d/])\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})(?![\d/])",
    "date_dot": r"(?<![\d.])\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})(?![\d.])",
    "date_iso": r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)",
    "date_month_year": r"(?<![\d/.])(?:0?[1-9]|1[0-2])[/.]\d{4}(?![\d/.])",
    "date_hebrew_month": rf"(?:\d{{1,2}} )?ב?(?:{_MONTHS_HE}) \d{{4}}",
    "date_latin_month": rf"(?:\d{{1,2}} (?:{_MONTHS_EN})[a-z]* \d{{4}}|(?:{_MONTHS_EN})[a-z]* \d{{1,2}},? \d{{4}}|(?:{_MONTHS_EN})[a-z]* \d{{4}})",
    "quarter_or_half": r"(?<![A-Za-z0-9])[QH][1-4](?![A-Za-z0-9])",
    "time_of_day": r"(?<![\d:])(?:[01]?\d|2[0-3]):[0-5]\d(?![\d:])",
    "number_with_unit": rf"\d(?:[\d,.]*\d)? ?{_UNITS}(?![A-Za-z{_H}])",
    "percent": r"\d%",
    "shekel_sign": "₪",
    "nis": r"(?<![A-Za-z])NIS(?![A-Za-z])",
    "shekel_abbreviation": 'ש"ח',
    "foreign_currency": r"(?<![A-Za-z])(?:USD|EUR)(?![A-Za-z])",
    "email": r"[a-z0-9.-]+@[a-z0-9-]+\.test(?![A-Za-z])",
    "url_or_domain": r"(?<![@A-Za-z0-9.-])(?:https?://)?(?:www\.)?[a-z0-9-]+\.test(?:/[A-Za-z0-9./-]*)?",
    "parenthesised_latin": r"\([^()]*[A-Za-z][^()]*\)",
    "parenthesised_hebrew": rf"\([^()A-Za-z]*[{_H}][^()A-Za-z]*\)",
    "version_string": r"(?<![A-Za-z0-9])v\d+(?:\.\d+)+|גרסה \d+(?:\.\d+)*|Rev\. ?[A-Z0-9]+|(?<![A-Za-z])V\d+\.\d+",
    "section_number": r"(?:סעיף|סעיפים|בסעיף|לסעיף|מסעיף|פרק|פריט|תת-סעיף) \d+(?:\.\d+)*",
    "grouped_number": r"\d{1,3}(?:,\d{3})+",
    "hyphenated_prefix": rf"[{_H}]-(?:\d|[A-Za-z])",
    "slash": "/",
    "colon": ":",
    "ascii_double_quote": '"',
    "gershayim_in_word": rf'[{_H}]"[{_H}]',
    "geresh_after_letter": rf"[{_H}]'",
    "digits_no_latin": r"^(?=.*\d)[^A-Za-z]*$",
    "plain_hebrew": r"^[^A-Za-z0-9]*$",
}
# ---- Fixed values: typographic mark classes, and the kinds that are counted for a line ----
MARK_CLASSES = {
    "gershayim_in_word": rf"[{_H}]״[{_H}]",
    "geresh_after_letter": rf"[{_H}]׳",
    "geresh_letter_numeral": rf"(?<![{_H}])[{_H}]׳(?![{_H}])",
    "geresh_foreign_sound": rf"[גזצ]׳[{_H}]",
    "em_dash": "—",
    "en_dash": "–",
    "en_dash_range": rf"[0-9{_H}׳]–[0-9{_H}]",
    "en_dash_spaced": " – ",
    "double_quotes": "“[^”]+”",
    "low_double_quotes": "„[^”]+”",
    "single_quotes": "‘[^’]+’",
    "ellipsis": "…",
    "semicolon": ";",
    "digits": r"\d",
    "latin": r"[A-Za-z]",
}
MARK_KINDS = ("gershayim_in_word", "geresh_after_letter", "em_dash", "en_dash_range", "en_dash_spaced", "double_quotes", "low_double_quotes", "single_quotes", "ellipsis", "semicolon")
# ---- Fixed values: sample features ----
FINAL_FORMS = "ךםןףץ"
_DATE = r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b"
_IDENTIFIER = "(?U)\\b[A-Za-z]+-[A-Za-z0-9\\u0590-\\u05ff-]*\\d[A-Za-z0-9\\u0590-\\u05ff-]*\\b|[\\u0590-\\u05ff]-\\d{2,5}-\\d{1,3}|מספר תיק \\d+/\\d+|מזהה \\S+"
_PUNCTUATION = r"""[.,:;!?'"()\-/]"""
_POINT = "[\\u0591-\\u05bd\\u05bf\\u05c1\\u05c2\\u05c4\\u05c5\\u05c7]"
# ---- Fixed values: privacy ----
RESERVED_HOST = r"^(?:[a-z0-9-]+\.)*(?:[a-z0-9-]+\.test|example\.(?:com|org|net))$"
DOMAIN_ENDS = "com|org|net|il|io|co|gov|edu|info|biz|test|example|invalid|ai|app|dev|me|tv|uk|us|eu"
BRANDS = (
    "microsoft|windows|excel|outlook|google|gmail|android|apple|iphone|ipad|macos|cisco|dell|"
    "lenovo|samsung|intel|nvidia|oracle|sap|ibm|xerox|siemens|philips|bosch|toyota|tesla|amazon|aws|azure|"
    "whatsapp|facebook|linkedin|youtube|adobe|autocad|vmware|salesforce"
)


def has_class(line: Column, name: str, table: dict[str, str] = TOKEN_CLASSES) -> Column:
    return line.rlike(unicode_digits(table[name]))


#: What a line must hold for a class to be looked for: most lines lack it, and a plain search is cheap.
_NEEDS = {
    "date_slash": "/", "date_dot": ".", "date_iso": "-", "date_hebrew_month": " ", "time_of_day": ":", "percent": "%", "nis": "NIS", "email": "@", "url_or_domain": ".test",
    "parenthesised_latin": "(", "parenthesised_hebrew": "(", "grouped_number": ",", "hyphenated_prefix": "-",
}
_DIGIT = ("alphanumeric_code", "date_slash", "date_dot", "date_iso", "date_month_year", "date_hebrew_month", "date_latin_month", "quarter_or_half", "time_of_day", "number_with_unit", "percent", "section_number", "grouped_number", "digits_no_latin")
_LATIN = (
    "latin_any", "latin_word", "acronym", "latin_run_2plus", "latin_run_3plus", "latin_at_start", "latin_at_end", "latin_in_middle", "alphanumeric_code", "date_latin_month",
    "quarter_or_half", "nis", "foreign_currency", "email", "url_or_domain", "parenthesised_latin",
)
_HEBREW = ("latin_in_middle", "date_hebrew_month", "parenthesised_hebrew", "section_number", "hyphenated_prefix", "gershayim_in_word", "geresh_after_letter", "shekel_abbreviation")


def class_counts(line: Column, table: dict[str, str] = TOKEN_CLASSES) -> list[Column]:
    """One aggregate for each class: lines that hold it; all run in one pass.

    Columns __digit, __latin and __hebrew, where the rows have them, say what a line holds and spare the patterns that need it."""
    return [F.count_if(class_test(line, n, p)).alias(n) for n, p in table.items()]


def unicode_digits(pattern: str) -> str:
    """The pattern with its digit class as the fixed values mean it: digits of all scripts."""
    return pattern.replace("\\d", "\\p{Nd}")


def class_test(line: Column, name: str, pattern: str) -> Column:
    test = line.rlike(unicode_digits(pattern))
    if TOKEN_CLASSES.get(name) != pattern:
        return test
    if name in _NEEDS:
        test = line.contains(_NEEDS[name]) & test
    for names, flag in ((_DIGIT, "__digit"), (_LATIN, "__latin"), (_HEBREW, "__hebrew")):
        if name in names:
            test = F.col(flag) & test
    return test


def class_flags(line: Column) -> dict[str, Column]:
    """The flags that `class_test` asks for."""
    less = lambda chars: F.octet_length(F.translate(line, chars, "")) < F.octet_length(line)
    letters = "".join(map(chr, range(ord("a"), ord("z") + 1)))
    return {"__digit": line.rlike(r"\p{Nd}"), "__latin": less(letters + letters.upper()), "__hebrew": line.rlike(f"[{_H}]")}


def mark_kind_count(line: Column) -> Column:
    return sum((line.rlike(MARK_CLASSES[k]).cast("int") for k in MARK_KINDS), F.lit(0))


def has_mark(line: Column) -> Column:
    return mark_kind_count(line) > 0


def text_features(text: Column) -> Column:
    """The features of a sample text, in a fixed order."""
    fuller = F.exists(tokens(text), lambda t: F.regexp_count(t, F.lit(_POINT)) >= 4)
    tests = {
        "final_forms": text.rlike(f"[{FINAL_FORMS}]"),
        "punctuation": text.rlike(_PUNCTUATION),
        "numerals": text.rlike(r"(?U)\d"),
        "dates": text.rlike(_DATE),
        "identifiers": text.rlike(_IDENTIFIER),
        "latin_fragments": text.rlike("[A-Za-z]"),
        "sparse_niqqud": text.rlike(_POINT),
        "fuller_niqqud": fuller,
        "nfc_logical_order_text": is_nfc(text),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def bidi_features(text: Column) -> Column:
    hebrew = text.rlike("[\\u0590-\\u05ff]")
    tests = {"hebrew_latin_fragments": text.rlike("[A-Za-z]"), "hebrew_numeric_fragments": text.rlike(r"(?U)\d"), "hebrew_punctuation": text.rlike(_PUNCTUATION)}
    return F.array_compact(F.array(*[F.when(hebrew & t, F.lit(n)) for n, t in tests.items()]))


def outside_allowed(line: Column, allowed: str) -> Column:
    """Distinct characters of a line outside a class such as 'A-Za-z0-9 '."""
    return F.array_sort(F.array_distinct(F.filter(characters(line), lambda c: ~c.rlike(f"^[{allowed}]$"))))


def balanced(line: Column, pairs: str = "()[]{}") -> Column:
    """Whether opening and closing marks nest, by a stack."""
    opening = {pairs[i + 1]: pairs[i] for i in range(0, len(pairs), 2)}
    opens, closes = F.array(*map(F.lit, opening.values())), F.create_map(*[F.lit(x) for kv in opening.items() for x in kv])
    start = F.struct(F.array().cast("array<string>").alias("k"), F.lit(True).alias("ok"))

    def step(s, c):
        top = F.get(s["k"], F.size(s["k"]) - 1)
        closing = closes[c].isNotNull()
        good = s["ok"] & (~closing | F.coalesce(top == closes[c], F.lit(False)))
        stack = F.when(F.array_contains(opens, c), F.concat(s["k"], F.array(c))).when(closing & (F.size(s["k"]) > 0), F.slice(s["k"], 1, F.size(s["k"]) - 1)).otherwise(s["k"])
        return F.struct(stack.alias("k"), good.alias("ok"))

    end = F.aggregate(characters(line), start, step)
    return end["ok"] & (F.size(end["k"]) == 0)


def orthography_faults(line: Column) -> Column:
    """Names of the spelling and spacing rules that a line breaks."""
    rules = {
        "medial_final_form": line.rlike(f"[{FINAL_FORMS}][{_H}]"),
        "non_final_ending": line.rlike(rf"(?<![{_H}׳״'\"])[{_H}]+[כמנפצ](?![{_H}׳״'\"])"),
        "unbalanced": ~balanced(line),
        "em_dash_spacing": line.rlike(r"\S—|—\S"),
        "ellipsis_spacing": line.rlike(r" …|…[^\s.,:;!?)”’]"),
        "three_stops": line.rlike(r"\.\.\."),
        "geresh_position": line.rlike(rf"(?<![{_H}])׳"),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in rules.items()]))


def privacy_rules(line: Column) -> dict[str, Column]:
    """Each privacy rule as a column that is true where a line breaks it."""
    runs = F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1))
    joined = F.regexp_extract_all(line, F.lit(r"(\d+(?:[- ]\d+)+)"), F.lit(1))
    hosts = F.regexp_extract_all(line, F.lit(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]*[A-Za-z0-9])"), F.lit(1))
    urls = F.regexp_extract_all(line, F.lit(r"(?:https?://|www\.)([A-Za-z0-9.-]*[A-Za-z0-9])"), F.lit(1))
    bare = F.regexp_extract_all(line, F.lit(rf"(?i)([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{DOMAIN_ENDS}))(?![A-Za-z0-9])"), F.lit(1))
    named = F.transform(F.concat(hosts, urls, bare), lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))
    return {
        "email": F.size(hosts) > 0,
        "url": F.size(urls) > 0,
        "open_domain": F.exists(named, lambda h: ~h.rlike(RESERVED_HOST)),
        "long_digit_run": F.exists(runs, lambda r: F.char_length(r) >= 7),
        "identity_number": F.exists(runs, lambda r: (F.char_length(r) >= 5) & check_digit_valid(r)),
        "joined_digits": F.exists(joined, lambda j: F.char_length(F.regexp_replace(j, r"\D", "")) >= 9),
        "brand": line.rlike(rf"(?i)(?<![A-Za-z])(?:{BRANDS})(?![A-Za-z])"),
    }


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in rules.items()]))


def privacy_hits(line: Column) -> Column:
    """Names of the privacy rules that a line breaks."""
    return _broken(privacy_rules(line))


def hygiene_faults(content: Column) -> Column:
    """Names of the file rules that a whole text breaks."""
    return _broken(hygiene_rules(content))


def hygiene_rules(content: Column) -> dict[str, Column]:
    """Each file rule as a column that is true where a text breaks it."""
    each = F.split(content, "\n", -1)
    body = F.slice(each, 1, F.size(each) - 1)
    return {
        "bom": content.startswith("﻿"),
        "carriage_return": content.contains("\r"),
        "no_final_line_feed": ~content.endswith("\n"),
        "blank_line": F.exists(body, lambda x: F.trim(x) == ""),
        "padding": F.exists(body, lambda x: (x != "") & x.rlike(r"^\s|\s$")),
        "double_space": content.contains("  "),
        "tab": content.contains("\t"),
    }


def admissibility(line: Column, levels: Column) -> Column:
    """Why a line is not admitted, the first reason only; null where it is admitted."""
    return F.when(line.rlike(r"\p{M}"), "marks").when(line.rlike(r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]"), "control_or_format").when(levels.isNull(), "unsupported_bidi")
