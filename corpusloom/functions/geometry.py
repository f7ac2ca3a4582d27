"""Boxes, polygons, segments and projections on array columns.  Inequalities are strict where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(a: Column, i) -> Column:
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Boxes [x0, y0, x1, y1]; touching edges do not overlap."""
    return (_at(a, 0) < _at(b, 2)) & (_at(b, 0) < _at(a, 2)) & (_at(a, 1) < _at(b, 3)) & (_at(b, 1) < _at(a, 3))


def grow_box(a: Column, by: Column | float) -> Column:
    by = F.lit(by) if not isinstance(by, Column) else by
    return F.array(_at(a, 0) - by, _at(a, 1) - by, _at(a, 2) + by, _at(a, 3) + by)


def signed_area(polygon: Column) -> Column:
    """Half the sum of cross products of neighbouring points."""
    n = F.size(polygon)

    def cross(i):
        p, q = _at(polygon, i), _at(polygon, (i + 1) % n)
        return (_at(p, 0) * _at(q, 1) - _at(q, 0) * _at(p, 1)).cast("double")

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), cross), F.lit(0.0), lambda a, x: a + x) / 2


def polygon_contains(outer: Column, points: Column, tolerance: float = 1.0) -> Column:
    """Whether every point is inside a convex polygon or at most `tolerance` outside; edges without length are skipped."""
    sign = F.when(signed_area(outer) >= 0, 1.0).otherwise(-1.0)
    n = F.size(outer)

    def inside(p):
        def edge(i):
            a, b = _at(outer, i), _at(outer, (i + 1) % n)
            dx, dy = _at(b, 0) - _at(a, 0), _at(b, 1) - _at(a, 1)
            cross = dx * (_at(p, 1) - _at(a, 1)) - dy * (_at(p, 0) - _at(a, 0))
            length = F.sqrt((dx * dx + dy * dy).cast("double"))
            return F.coalesce(F.try_divide(sign * cross, F.nullif(length, F.lit(0.0))) >= -tolerance, F.lit(True))

        return F.forall(F.sequence(F.lit(0), n - 1), edge)

    return F.forall(points, inside)


def segment_hits_box(p: Column, q: Column, box: Column) -> Column:
    """Parametric clipping of a segment against four half-planes."""
    dx, dy = (_at(q, 0) - _at(p, 0)).cast("double"), (_at(q, 1) - _at(p, 1)).cast("double")
    limits = F.array(
        F.struct((-dx).alias("d"), (_at(p, 0) - _at(box, 0)).cast("double").alias("r")),
        F.struct(dx.alias("d"), (_at(box, 2) - _at(p, 0)).cast("double").alias("r")),
        F.struct((-dy).alias("d"), (_at(p, 1) - _at(box, 1)).cast("double").alias("r")),
        F.struct(dy.alias("d"), (_at(box, 3) - _at(p, 1)).cast("double").alias("r")),
    )
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def clip(s, c):
        t = F.try_divide(c["r"], c["d"])
        lo = F.when(c["d"] < 0, F.greatest(s["lo"], t)).when((c["d"] == 0) & (c["r"] < 0), 2.0).otherwise(s["lo"])
        hi = F.when(c["d"] > 0, F.least(s["hi"], t)).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    end = F.aggregate(limits, start, clip)
    return end["lo"] <= end["hi"]


def rotate(point: Column, degrees: Column, width: Column, height: Column) -> Column:
    """A point turned about the centre of a canvas."""
    t, cx, cy = F.radians(degrees), width / 2, height / 2
    x, y = _at(point, 0) - cx, _at(point, 1) - cy
    return F.array(cx + x * F.cos(t) + y * F.sin(t), cy - x * F.sin(t) + y * F.cos(t))


def clamp(point: Column, width: Column, height: Column) -> Column:
    """Nearest whole pixel (half to even) inside a canvas."""
    hold = lambda v, top: F.greatest(F.lit(0), F.least(F.rint(v).cast("int"), (top - 1).cast("int")))
    return F.array(hold(_at(point, 0), width), hold(_at(point, 1), height))


def ellipse(box: Column, n: int, start: float = 0.0, end: float = 360.0) -> Column:
    """n + 1 points along an arc inside a box."""
    cx, cy = (_at(box, 0) + _at(box, 2)) / 2, (_at(box, 1) + _at(box, 3)) / 2
    rx, ry = (_at(box, 2) - _at(box, 0)) / 2, (_at(box, 3) - _at(box, 1)) / 2

    def point(i):
        t = F.radians(F.lit(start) + (end - start) * i / n)
        return F.array(cx + rx * F.cos(t), cy + ry * F.sin(t))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), point)


def apply_homography(h: Column, point: Column) -> Column:
    """A projective map (nine numbers by rows) of a point."""
    x, y = _at(point, 0), _at(point, 1)
    row = lambda i: _at(h, 3 * i) * x + _at(h, 3 * i + 1) * y + _at(h, 3 * i + 2)
    return F.array(F.try_divide(row(0), row(2)), F.try_divide(row(1), row(2)))


def invert_homography(h: Column) -> Column:
    """Adjugate over determinant, scaled so that the last number is 1."""
    a, b, c, d, e, f, g, k, i = (_at(h, j) for j in range(9))
    adj = [e * i - f * k, c * k - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d]
    return F.array(*[F.try_divide(x, adj[8]) for x in adj])


def in_frame(quad: Column, width: Column, height: Column) -> Column:
    return F.forall(quad, lambda p: (_at(p, 0) >= 0) & (_at(p, 1) >= 0) & (_at(p, 0) <= width) & (_at(p, 1) <= height))


def bounding_box(quad: Column) -> Column:
    xs, ys = F.transform(quad, lambda p: _at(p, 0)), F.transform(quad, lambda p: _at(p, 1))
    return F.array(F.floor(F.array_min(xs)), F.floor(F.array_min(ys)), F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys)))


def map_range(value: Column, src: tuple[float, float], dst: tuple[float, float]) -> Column:
    """A value moved from one range to another, rounded half to even."""
    span = src[1] - src[0]
    return F.lit(dst[0]) + F.rint((value - src[0]) * (dst[1] - dst[0]) / span) if span else F.lit(dst[0])


def ink_density(histogram: Column, threshold: int = 128) -> Column:
    """Share of pixels at or below a threshold, from a histogram of 256 bins."""
    add = lambda a, x: a + x
    dark = F.aggregate(F.slice(histogram, 1, threshold + 1), F.lit(0).cast("long"), add)
    return F.coalesce(F.try_divide(dark, F.aggregate(histogram, F.lit(0).cast("long"), add)), F.lit(0.0))


def histogram_percentile(histogram: Column, q: float) -> Column:
    """Least bin at which the running count reaches q of the total."""
    add = lambda a, x: a + x
    total = F.aggregate(histogram, F.lit(0).cast("long"), add)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("bin"), F.lit(0).alias("i"))

    def step(s, x):
        upto = s["sum"] + x
        return F.struct(upto.alias("sum"), F.when((s["bin"] < 0) & (upto >= total * q), s["i"]).otherwise(s["bin"]).alias("bin"), (s["i"] + 1).alias("i"))

    return F.aggregate(histogram, start, step)["bin"]


def otsu(histogram: Column) -> Column:
    """Threshold with the largest between-class variance, the first on ties."""
    bins = F.sequence(F.lit(0), F.size(histogram) - 1)
    add = lambda a, x: a + x
    weighted = F.zip_with(histogram, bins, lambda n, i: (n * i).cast("double"))
    total = F.aggregate(histogram, F.lit(0).cast("long"), add)
    mass = F.aggregate(weighted, F.lit(0.0), add)

    def score(t):
        w = F.aggregate(F.slice(histogram, 1, t + 1), F.lit(0).cast("long"), add)
        m = F.aggregate(F.slice(weighted, 1, t + 1), F.lit(0.0), add)
        gap = F.try_divide(m, w) - F.try_divide(mass - m, total - w)
        return F.struct(F.coalesce(w * (total - w) * gap * gap, F.lit(0.0)).alias("v"), (-t).alias("t"))

    return -F.array_max(F.transform(bins, score))["t"]
