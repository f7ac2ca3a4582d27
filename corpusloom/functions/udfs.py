"""Arrow functions for what Spark has no expression for: normal form, bidirectional levels, context patterns, homographies, seeded strings."""

from __future__ import annotations

import json
import random
import re
import unicodedata
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Normal form C.  Spark calls the function for every row, so texts of ASCII only go to it as nulls."""
    return F.coalesce(_nfc(F.when(F.octet_length(text) != F.char_length(text), text)), text)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_signatures(hashes: Column, percent: float) -> Column:
    """Signatures of a set, given as 64-bit hashes of its elements; sets with a Jaccard similarity of at least
    percent / 100 have one in common.

    Sizes are cut into ranges so that near sets are in one range or in neighbours.  A set is dealt by its elements'
    hashes into parts for its own range and for the next, one part more than the elements in which two near sets of
    these sizes can differ; so one part at least is equal.  A signature is the range, the part and the sum of its hashes."""
    share = Fraction(percent) / 100

    @F.arrow_udf(ArrayType(LongType()))
    def signatures(a: pa.Array) -> pa.Array:
        size = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = [0]
        while ends[-1] < size.max(initial=0):
            ends.append(int((ends[-1] + 1) / share))
        ends.append(int((ends[-1] + 1) / share))
        parts = np.array([int(2 * n * (1 - share) / (1 + share)) + 1 for n in ends], np.int64)
        own = np.searchsorted(ends, size)  # the range of each set: sizes up to ends[own]
        values, starts = a.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.append(0, np.cumsum(size))
        out, counts = [], np.where(size > 0, parts[own] + parts[own + (size > 0)], 0)
        for at in range(0, len(size), 1000):  # bounds the memory
            n, r = size[at : at + 1000], own[at : at + 1000]
            v = values[starts[at] : starts[at + len(n)]]
            first = np.append(0, np.cumsum(counts[at : at + 1000]))
            sums, names = np.zeros(first[-1], np.uint64), np.zeros(first[-1], np.uint64)
            shift = np.zeros(len(n), np.int64)
            for k in (r, r + (n > 0)):
                m = np.where(n > 0, parts[k], 0)
                begin = first[:-1] + shift
                place = np.repeat(begin, n) + ((v >> np.uint64(20)) % np.repeat(m, n).astype(np.uint64)).astype(np.int64)
                np.add.at(sums, place, v)
                slots = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)  # 0 to m - 1 for each set
                names[np.repeat(begin, m) + slots] = (np.repeat(k, m).astype(np.uint64) << np.uint64(32)) + slots.astype(np.uint64)
                shift = m
            out.append(_mixed(sums + _mixed(names + np.uint64(0x9E3779B97F4A7C15))).view(np.int64))
        offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.concatenate(out) if out else np.zeros(0, np.int64))

    return signatures(hashes)


def compare_sets(percent: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (place, i, j, ha, hb, id, text, more) ordered by place, i, j: sets, whose hb is null
    and whose elements are the lines of text or, where that is null, more, and after them the pairs of hashes to compare.  Yields (a, b, both, either) of pairs similar enough, a with the lesser id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        for batch in batches:
            place, i, j, ha, hb, ids = (batch.column(c).to_pylist() for c in range(6))
            texts, sets, out = batch.column(6).to_pylist(), batch.column(7), []
            values, ends = sets.flatten().to_pylist(), np.cumsum(sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            for r, end in enumerate(ends):
                if here != (at := (place[r], i[r], j[r])):
                    here, held = at, {}
                if hb[r] is None:
                    held.setdefault(ha[r], []).append((ids[r], set(values[ends[r - 1] if r else 0 : end] if texts[r] is None else texts[r].split("\n"))))
                    continue
                for a, x in held[ha[r]]:
                    for b, y in held[hb[r]]:
                        if a < b:
                            both = len(x & y)
                            either = len(x) + len(y) - both
                            if both * 100 >= either * percent:
                                out.append((a, b, both, either))
            kinds = (batch.schema.field(5).type, batch.schema.field(5).type, pa.int32(), pa.int32())
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "both", "either"])

    return run


def is_nfc(text: Column) -> Column:
    return text == nfc(text)


def levels_of(text: str) -> list[int] | None:
    """Reduced bidirectional levels in a right-to-left paragraph: 1 right-to-left, 2 left-to-right run.

    None where a left-to-right run holds a space or a mirrored character."""
    kinds = []
    for c in text:  # marks follow their base, Arabic counts as right-to-left
        k = unicodedata.bidirectional(c) or "ON"
        kinds.append((kinds[-1] if kinds else "R") if k == "NSM" else {"AL": "R", "AN": "EN"}.get(k, k))
    joined = list(kinds)
    for m in re.finditer(r"(?<=n)s(?=n)", "".join("n" if k == "EN" else "s" if k in ("ES", "CS") else "-" for k in kinds)):
        joined[m.start()] = "EN"
    for m in re.finditer(r"t+", "".join("t" if k == "ET" else "-" for k in joined)):
        a, b = m.span()
        if (a and joined[a - 1] == "EN") or (b < len(joined) and joined[b] == "EN"):
            joined[a:b] = ["EN"] * (b - a)
    side, strong = "R", []
    for k in joined:  # numbers after a Latin letter are Latin
        side = k if k in ("L", "R") else side
        strong.append("L" if k == "L" or (k == "EN" and side == "L") else "N" if k == "EN" else "R" if k == "R" else ".")
    out = "".join(strong)
    for m in list(re.finditer(r"\.+", out)):
        a, b = m.span()
        before, after = out[a - 1] if a else "R", out[b] if b < len(out) else "R"
        out = out[:a] + ("L" if before == after == "L" else "R") * (b - a) + out[b:]
    levels = [2 if k in "LN" else 1 for k in out]
    if any(v == 2 and (c.isspace() or unicodedata.mirrored(c)) for c, v in zip(text, levels, strict=True)):
        return None
    return levels


@F.pandas_udf(ArrayType(IntegerType()))
def bidi_levels(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else levels_of(x))


def order_of(levels: list[int]) -> list[int]:
    """Places in right-to-left order: logical order with left-to-right runs reversed."""
    out = []
    for m in re.finditer(r"2+|1", "".join(map(str, levels))):
        out += reversed(range(*m.span()))
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def rtl_order(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else order_of([int(i) for i in x]))


def number_context(token: str, read: str) -> str:
    """How a missed number of several groups shows up in a reading; the first class that fits.

    Class names, their order and the gap patterns are fixed values."""
    left, right = r"(?<!\d)(?<!\d[.,/])", r"(?!\d)(?![.,/]\d)"
    groups = re.split(r"[.,/]", token)
    space = r"\s*[.,/]?\s+[.,/]?\s*|\s+"
    has = lambda gs, gap: re.search(left + f"(?:{gap})".join(map(re.escape, gs)) + right, read)
    back = groups[::-1]
    classes = [
        ("reversed_groups_no_space", lambda: has(back, "[.,/]")),
        ("reversed_groups_with_space", lambda: has(back, space)),
        ("same_order_with_space", lambda: has(groups, space)),
        ("separators_dropped", lambda: has(groups, "") or has(back, "")),
        ("same_order_sep_changed_or_doubled", lambda: has(groups, "[.,/]{1,2}")),
        ("groups_scattered", lambda: all(has([g], "") for g in groups)),
        ("some_groups_only", lambda: any(len(g) > 1 and has([g], "") for g in groups)),
    ]
    return next((name for name, test in classes if test()), "no_group")


@F.pandas_udf(StringType())
def number_context_class(token: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or r is None else number_context(t, r) for t, r in zip(token, read, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def homography(src: pd.Series, dst: pd.Series) -> pd.Series:
    """Nine numbers of the projective map that takes four points to four points."""

    def solve(a, b):
        if a is None or b is None:
            return None
        rows = []
        for (x, y), (u, v) in zip(a, b, strict=True):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        return [*np.linalg.solve(np.array(rows, float), np.array([c for p in b for c in p], float)).tolist(), 1.0]

    return pd.Series([solve(a, b) for a, b in zip(src, dst, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def json_strings(s: pd.Series) -> pd.Series:
    """All strings of a JSON value, in order; null where it does not parse."""

    def walk(v):
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            for x in v.values():
                yield from walk(x)
        elif isinstance(v, list):
            for x in v:
                yield from walk(x)

    def read(x):
        try:
            return list(walk(json.loads(x)))
        except (TypeError, ValueError):
            return None

    return s.map(read)


def seeded_number(seed: int, kind: str) -> str:
    """A generated label, date, short integer, amount or percent; properties only, not a given random stream."""
    r = random.Random(seed)
    if kind == "label":
        return ".".join(str(r.randint(1, 12)) for _ in range(r.randint(1, 3)))
    if kind == "date":
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1990, 2030)
        return r.choice([f"{d}.{m}.{y}", f"{d:02}/{m:02}/{y}", f"{d}/{m}/{y % 100:02}", f"{m:02}/{y}", f"{y}-{m:02}-{d:02}"])
    if kind == "short_int":
        return str(r.randint(1, 999))
    if kind == "amount":
        return f"{r.randint(1000, 999999):,}" + r.choice(["", ".00", f".{r.randint(10, 99)}"])
    return f"{r.randint(1, 100)}%"


@F.pandas_udf(StringType())
def generated_number(seed: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else seeded_number(int(s), k) for s, k in zip(seed, kind, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def section_labels(depths: pd.Series) -> pd.Series:
    """Hierarchical numbers 1, 1.1, 1.2, 2 ... of a list of depths."""

    def number(ds):
        if ds is None:
            return None
        at, out = [], []
        for d in ds:
            at = at[: int(d)] + [0] * (int(d) - len(at))
            at[-1] += 1
            out.append(".".join(map(str, at)))
        return out

    return depths.map(number)
