"""Clipping of lines and polygons to rectangles, with array functions inside each row: nothing shuffles.

Whole coordinates are rounded half away from zero. A side may be open: then what only touches or runs along it is left out,
so that neighbouring rectangles with complementary sides own every point and every line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import EXTENT, SHAPES, _let, _segments, overzoomed, point, shape

def _ring_side(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
    """A ring without what lies beyond one side of a rectangle."""
    inside = lambda p: (p[axis] >= limit) if keep_above else (p[axis] <= limit)

    def cut(s: Column) -> Column:
        a, b = s["a"], s["b"]
        t = F.try_divide(limit - a[axis], b[axis] - a[axis])
        at = {k: limit.cast("double") if k == axis else a[k] + (b[k] - a[k]) * t for k in "xy"}
        crossing = F.when(inside(a) != inside(b), F.array(point(at["x"], at["y"]))).otherwise(F.array().cast(SHAPES["points"]))
        return F.concat(F.when(inside(a), F.array(a)).otherwise(F.array().cast(SHAPES["points"])), crossing)

    return F.flatten(F.transform(_segments(ring, True), cut))


def _beyond(axis: str, limit: Column, keep_above: bool):
    return lambda ring: _ring_side(ring, axis, limit, keep_above)


def _tidy(ring: Column) -> Column:
    """Rounded, without vertices that repeat the one before (the last: the first)."""
    whole = F.transform(ring, lambda p: point(F.round(p["x"]), F.round(p["y"])))
    empty = F.array().cast(SHAPES["points"])
    once = F.aggregate(whole, empty, lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == p), acc).otherwise(F.concat(acc, F.array(p))))
    last = lambda r: F.when((F.size(r) > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    return _let(once, last)


def _has_area(ring: Column) -> Column:
    twice = F.aggregate(_segments(ring, True), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return (F.size(ring) >= 3) & (twice != 0)


def clip_polygons(polygons: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """array<array<ring>>: polygons within a rectangle; parts that a side cuts off each other stay joined along that side.

    Polygons without area there are dropped, as are holes.
    """

    def clipped(ring: Column) -> Column:
        for axis, limit, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
            ring = _let(ring, _beyond(axis, limit, above))
        return _tidy(ring)

    return _with_area(polygons, clipped)


def tidy_polygons(polygons: Column) -> Column:
    """``clip_polygons`` for polygons that lie within the rectangle."""
    return _with_area(polygons, _tidy)


def _with_area(polygons: Column, of_ring) -> Column:
    def polygon(rings: Column) -> Column:
        cut = F.transform(rings, of_ring)
        kept = F.filter(F.transform(cut, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda q: (q["i"] == 0) | _has_area(q["r"]))
        return F.transform(kept, lambda q: q["r"])

    return F.filter(F.transform(polygons, polygon), lambda p: _has_area(p[0]))


def clip_lines(lines: Column, x0: Column, y0: Column, x1: Column, y1: Column, open_sides: str = "") -> Column:
    """array<line>: the stretches of lines within a rectangle; ``open_sides`` names sides (w, n, e, s) that are left out."""
    ends = {"w": ("x", x0), "e": ("x", x1), "n": ("y", y0), "s": ("y", y1)}

    def part(s: Column) -> Column:
        """The share [t0, t1] of a segment inside, null if there is none."""
        a, b = s["a"], s["b"]
        t0, t1, out = F.lit(0.0), F.lit(1.0), F.lit(False)
        for side, (axis, limit) in ends.items():
            d = b[axis] - a[axis] if side in "es" else a[axis] - b[axis]
            room = limit - a[axis] if side in "es" else a[axis] - limit
            t = F.try_divide(room, d)
            t1 = F.when(d > 0, F.least(t1, t)).otherwise(t1)
            t0 = F.when(d < 0, F.greatest(t0, t)).otherwise(t0)
            out = out | ((d == 0) & ((room <= 0) if side in open_sides else (room < 0)))
        return F.when(~out & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))

    def on(s: Column, t: Column) -> Column:
        a, b = s["a"], s["b"]
        return point(F.round(a["x"] + (b["x"] - a["x"]) * t), F.round(a["y"] + (b["y"] - a["y"]) * t))

    none = F.array().cast(SHAPES["points"])
    acc0 = F.struct(F.array().cast(SHAPES["lines"]).alias("done"), none.alias("now"))

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["now"]) >= 2, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])

    def line(r: Column) -> Column:
        pieces = F.transform(_segments(r, False), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), part(s).alias("in")))

        def step(acc: Column, s: Column) -> Column:
            p, q = on(s, s["in"]["t0"]), on(s, s["in"]["t1"])
            follows = (F.size(acc["now"]) > 0) & (s["in"]["t0"] == 0)
            tail = F.when(p == q, none).otherwise(F.array(q))
            grown = F.when(follows, F.concat(acc["now"], tail)).otherwise(F.concat(F.array(p), tail))
            # A stretch that leaves ends here.
            after = F.struct(F.when(follows, acc["done"]).otherwise(closed(acc)).alias("done"), grown.alias("now"))
            ended = lambda x: F.struct(closed(x).alias("done"), none.alias("now"))
            whole = _let(after, lambda x: F.when(s["in"]["t1"] < 1, ended(x)).otherwise(x))
            return F.when(s["in"].isNull(), ended(acc)).otherwise(whole)

        return F.aggregate(pieces, acc0, step, closed)

    return F.flatten(F.transform(lines, line))


def clip_points(points: Column, x0: Column, y0: Column, x1: Column, y1: Column, open_sides: str = "") -> Column:
    def inside(p: Column) -> Column:
        low = lambda v, limit, side: (v > limit) if side in open_sides else (v >= limit)
        high = lambda v, limit, side: (v < limit) if side in open_sides else (v <= limit)
        return low(p["x"], x0, "w") & high(p["x"], x1, "e") & low(p["y"], y0, "n") & high(p["y"], y1, "s")

    return F.filter(points, inside)


def clip(df: DataFrame, x0: float = 0, y0: float = 0, x1: float = EXTENT, y1: float = EXTENT, open_sides: str = "") -> DataFrame:
    """Features within a rectangle; those with nothing there go."""
    box = [F.lit(float(v)) for v in (x0, y0, x1, y1)]
    ways = {"points": lambda c: clip_points(c, *box, open_sides), "lines": lambda c: clip_lines(c, *box, open_sides), "polygons": lambda c: clip_polygons(c, *box)}
    own = [n for n in SHAPES if n in df.columns]
    out = df.withColumns({n: ways[n](shape(df, n)) for n in own})
    some = F.lit(False)
    for n in own:
        some = some | (F.size(n) > 0)
    return out.where(some)


def overzoom(df: DataFrame, z: int, pad: float = 0.0, extent: int = EXTENT) -> DataFrame:
    """Features of ancestor tiles in the tiles at ``z``, clipped to these and ``pad`` units around."""
    return clip(overzoomed(df, z, extent), -pad, -pad, extent + pad, extent + pad)
