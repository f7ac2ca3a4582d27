"""Scalar text functions on columns: white space, tokens, n-grams, hashes, folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that split words, and characters that end lines.
SPACES = "\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# Label fold, one character for one.
FOLD_FROM = "״׳־“”„–—"
FOLD_TO = "\"'-\"\"\"--"

# Hebrew letters and the sixteen vowel points.
HEBREW = "א-ת"
NIQQUD = "ְ-ׇּׁׂ"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.array_join(tokens(text), " ")


# The characters of SPACES and the single ones of LINE_ENDS.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def tokens(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    plain = F.translate(text, _SPACES, " " * len(_SPACES))  # one pass over the characters, no pattern
    return F.array_remove(F.split(plain, " "), "")


def lines_stripped(text: Column) -> Column:
    """Lines at any line end, stripped, blank ones dropped."""
    plain = F.translate(text, _LINE_ENDS, "\n" * len(_LINE_ENDS))  # an empty line more for CR LF is dropped below
    return F.array_remove(F.transform(F.split(plain, "\n"), lambda x: F.trim(x, F.lit(_SPACES))), "")


def lines_strict(text: Column) -> Column:
    """Pieces between line feeds without the last, nothing stripped."""
    pieces = F.split(text, "\n", -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space, with repeats."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int) -> Column:
    """Runs of n characters, spaces included, with repeats."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))  # one walk over the text


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_seed(seed: int, key: Column) -> Column:
    """First 16 hexadecimal digits of sha256("seed:key") as an integer."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_split(key: Column, fraction: float) -> Column:
    """Whether a key's hash falls into the first `fraction` of 32 bits."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") < fraction * 4294967296


def skeleton(text: Column) -> Column:
    """Digit runs become 0, Latin runs become a."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), "[A-Za-z]+", "a")


def fold_label(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def squash_family(name: Column) -> Column:
    """Font family for comparison: lower case without spaces, hyphens and underscores."""
    return F.lower(F.translate(name, " -_", ""))


def char_class(c: Column) -> Column:
    """Class of one character; the order of tests matters."""
    return (
        F.when(c.rlike(f"^[{HEBREW}]$"), "hebrew_letter")
        .when(c.rlike(f"^[{NIQQUD}]$"), "niqqud")
        .when(c.rlike(r"^(?U)\d$"), "digit")
        .when(c.rlike("^[A-Za-z]$"), "latin")
        .when(c == " ", "space")
        .otherwise("punctuation_symbol")
    )


def corpus_id(name: Column, content_sha256: Column, packaged: list[str]) -> Column:
    """A packaged corpus goes by its name, any other by its hash."""
    return F.when(name.isin(packaged), name).otherwise(F.concat(F.lit("external:sha256:"), content_sha256))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_id(ts: Column) -> Column:
    return F.concat(F.lit("evidence-"), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))


def optional_int(value: Column) -> Column:
    """A JSON value as an integer; booleans, fractions and text are not integers."""
    return F.when(value.rlike(r"^-?\d+$"), value.try_cast("long"))


def json_location(parts: Column) -> Column:
    """Path parts as $.a[0].b; parts are strings, numbers stand for places."""
    return F.concat(F.lit("$"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("."), p))), ""))


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, 0 where b is 0; rounded half up where digits are given."""
    r = F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return F.round(r, digits) if digits is not None else r


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance without spaces over the reference's length."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return F.levenshtein(bare(reference), bare(hypothesis)) / F.greatest(F.char_length(bare(reference)), F.lit(1))


def join_tokens(tokens_col: Column) -> Column:
    """Tokens joined by spaces with the offset of each: struct<text, starts>."""
    zero = F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("starts"))

    def step(acc, t):
        text = F.when(acc["text"] == "", t).otherwise(F.concat(acc["text"], F.lit(" "), t))
        start = (F.char_length(text) - F.char_length(t)).cast("int")
        return F.struct(text.alias("text"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    return F.aggregate(tokens_col, zero, step)


def wrap_chars(words: Column, width: int) -> Column:
    """Greedy wrap of words into lines of at most `width` characters; a longer word stands alone."""
    none = F.array().cast("array<string>")

    def step(acc, w):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.char_length(last) + 1 + F.char_length(w) <= width)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(words, none, lambda acc, w: F.when(F.size(acc) == 0, F.array(w)).otherwise(step(acc, w)))
