"""Number tokens, check digits, numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the number token.
NUMBER = r"\d+(?:[.,/]\d+)*%?"


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))


def number_shape(t: Column) -> Column:
    """Shape class of a number token; the first that fits.  Names, patterns and order are fixed values."""
    return (
        F.when(t.endswith("%"), "percent")
        .when(t.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{2,4}$"), "date")
        .when(t.contains(","), "thousands")
        .when(t.rlike(r"^\d+\.\d+$"), "decimal_or_section")
        .when(t.contains("/"), "slash_ref")
        .when(t.rlike(r"^\d+(\.\d+){2,}$"), "section_multi")
        .when(F.char_length(t) < 6, F.concat(F.lit("int_len"), F.char_length(t).cast("string")))
        .otherwise("int_len6+")
    )


def reordered(a: Column, b: Column) -> Column:
    """Whether b is a read backwards, by characters or by groups."""
    groups = F.split(a, "[.,/]")
    return (a != b) & ((b == F.reverse(a)) | ((F.size(groups) > 1) & (F.reverse(groups) == F.split(b, "[.,/]"))))


def check_digit_valid(digits: Column) -> Column:
    """Nine digits (zero padded) whose weights 1, 2, 1, 2 ... sum, digit sums of products, to a multiple of ten."""
    padded = F.lpad(digits, 9, "0")
    weighted = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substr(padded, i, F.lit(1)).try_cast("int") * (2 - i % 2))
    total = F.aggregate(F.transform(weighted, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return (F.char_length(digits) <= 9) & digits.rlike("^[0-9]+$") & (total % 10 == 0)


# Letters by value.
_UNITS = ["", "א", "ב", "ג", "ד", "ה", "ו", "ז", "ח", "ט"]
_TENS = ["", "י", "כ", "ל", "מ", "נ", "ס", "ע", "פ", "צ"]
_HUNDREDS = ["", "ק", "ר", "ש", "ת", "תק", "תר", "תש", "תת", "תתק"]


def hebrew_numeral(n: Column) -> Column:
    """1 to 999 as letters; 15 and 16 avoid two letters of the divine name; null outside."""
    pick = lambda table, i: F.element_at(F.array(*map(F.lit, table)), (i + 1).cast("int"))
    rest = n % 100
    low = F.when(rest == 15, "טו").when(rest == 16, "טז").otherwise(F.concat(pick(_TENS, F.floor(rest / 10)), pick(_UNITS, rest % 10)))
    return F.when((n >= 1) & (n <= 999), F.concat(pick(_HUNDREDS, F.floor(n / 100)), low))


def hebrew_numeral_marked(n: Column) -> Column:
    """1 to 499 with an apostrophe after one letter, or a double quote before the last of several."""
    bare = hebrew_numeral(n)
    size = F.char_length(bare)
    marked = F.when(size == 1, F.concat(bare, F.lit("'"))).otherwise(F.concat(F.substr(bare, F.lit(1), size - 1), F.lit('"'), F.substr(bare, size, F.lit(1))))
    return F.when(n <= 499, marked)
