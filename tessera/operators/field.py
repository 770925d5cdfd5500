"""Operators on scalar fields. Missing samples are nulls and stay missing unless an operator says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.arith import apply, clamp, to_byte
from .grid import PIXEL, TILE, Grid, neighbourhood

V = F.col


def map_range(field: Grid, in_min: float, in_max: float, out_min: float, out_max: float, clamped: bool = False) -> Grid:
    """Linear remap; an empty input range gives the middle of the output range."""
    span = in_max - in_min
    v = V("v")
    out = F.when(v.isNotNull(), F.lit((out_min + out_max) / 2)) if abs(span) < 1e-9 else out_min + (v - in_min) / span * (out_max - out_min)
    if clamped:
        out = F.when(v.isNotNull(), clamp(out, min(out_min, out_max), max(out_min, out_max)))
    return field.select(v=out)


def threshold(field: Grid, value: float, low: float = 0.0, high: float = 1.0, softness: float = 0.0) -> Grid:
    """``low`` up to ``value``, ``high`` above; ``softness`` is the width of a ramp around it."""
    v = V("v")
    if softness > 0:
        t = clamp((v - (value - softness / 2)) / softness, 0, 1)
        out = low + (high - low) * t
    else:
        out = F.when(v <= value, F.lit(float(low))).otherwise(F.lit(float(high)))
    return field.select(v=F.when(v.isNotNull(), out))


def field_math(name: str, *operands: Grid | float) -> Grid:
    """A function of the arithmetic table per pixel; fields must have equal sizes."""
    fields = [o for o in operands if isinstance(o, Grid)]
    if not fields or len({(f.width, f.height) for f in fields}) > 1:
        raise ValueError("field-math needs fields of one size")
    df, columns = None, []
    for i, o in enumerate(operands):
        if isinstance(o, Grid):
            own = o.df.select(*PIXEL, V("v").alias(f"v{i}"))
            df = own if df is None else df.join(own, list(PIXEL))
            columns.append(V(f"v{i}"))
        else:
            columns.append(F.lit(float(o)))
    return fields[0].with_df(df.select(*PIXEL, apply(name, *columns).alias("v")))


def density(points: DataFrame, size: int, radius: float, weight: Column | float = 1.0, intensity: float = 1.0) -> Grid:
    """Kernel density of points (z, x, y, fx, fy in pixels): each adds weight * intensity / sqrt(2 pi) * exp(-4.5 (d/r)^2).

    A point is exploded to the pixels of the world that its kernel reaches, whatever tile they are in; x wraps around, y
    stops at the poles. Sums are combined before the shuffle. Null weights add nothing.
    """
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    world = F.pow(F.lit(2.0), V("z")) * size
    rows = points.select("z", (V("x") * size + V("fx")).alias("wx"), (V("y") * size + V("fy")).alias("wy"), w.alias("w"))
    rows = rows.where(F.col("w").isNotNull()).withColumn("world", world.cast("long"))
    reach = lambda c: F.sequence(F.floor(V(c) - radius - 0.5), F.ceil(V(c) + radius - 0.5))
    rows = rows.withColumn("qx", F.explode(reach("wx"))).withColumn("qy", F.explode(reach("wy"))).where("qy >= 0 AND qy < world")
    d2 = (F.pow(V("qx") + 0.5 - V("wx"), F.lit(2)) + F.pow(V("qy") + 0.5 - V("wy"), F.lit(2))) / radius**2
    rows = rows.withColumn("d2", d2).where("d2 < 1").withColumn("qx", F.pmod("qx", "world"))
    cell = lambda c, n: F.floor(V(c) / size).cast("int").alias(n)
    within = lambda c, n: (V(c) % size).cast("int").alias(n)
    rows = rows.select("z", cell("qx", "x"), cell("qy", "y"), within("qx", "px"), within("qy", "py"), "w", "d2")
    add = V("w") * (intensity / math.sqrt(2 * math.pi)) * F.exp(-4.5 * V("d2"))
    return Grid(rows.groupBy(*PIXEL).agg(F.sum(add).alias("v")), size, size)


def ramp(value: Column, stops: list[tuple[float, str]], interpolation: str = "linear") -> list[Column]:
    """r, g, b, a (shares of 1) of a value between colour stops; beyond the ends, the ends' colours."""
    stops = [(s, color.parse(c)) for s, c in sorted(stops)]
    chosen = [F.lit(c) for c in stops[0][1]]
    for (s0, c0), (s1, c1) in zip(stops[:-1], stops[1:]):
        if interpolation == "step":
            here = [F.lit(c) for c in c0]
        else:
            t = (value - s0) / (s1 - s0)
            here = [p + (q - p) * t for p, q in zip(c0, c1)]
            here = [F.round(c * 255) / 255 for c in here]
        chosen = [F.when(value >= s0, h).otherwise(o) for h, o in zip(here, chosen)]
    return [F.when(value >= stops[-1][0], F.lit(c)).otherwise(o) for c, o in zip(stops[-1][1], chosen)]


def color_ramp(source: Grid, stops: list[tuple[float, str]], interpolation: str = "linear", opacity: float = 1.0) -> Grid:
    """Colours of a field, or of a raster by its luminance; missing samples are transparent (no row)."""
    if "v" in source.bands:
        r, g, b, a = ramp(V("v"), stops, interpolation)
        alpha = a * min(max(opacity, 0), 1)
        known = source.with_df(source.df.where("v IS NOT NULL"))
    else:
        r, g, b, a = ramp(clamp(color.luma(*color.straight()), 0, 1), stops, interpolation)
        alpha, known = a * min(max(opacity, 0), 1) * V("a") / 255, source
    return known.with_df(known.df.select(*PIXEL, *color.premultiplied([r, g, b], alpha), to_byte(alpha).alias("a")))


def gradient(field: Grid) -> DataFrame:
    """The dense field with gx and gy, the 3 x 3 weighted slopes; a missing neighbour counts as the centre."""
    n = neighbourhood(field)
    z = {k: F.coalesce(V(k), V("c")) for k in ("nw", "n", "ne", "w", "e", "sw", "s", "se")}
    across = 8.0 * max(field.pitch, 1e-6)
    gx = ((z["ne"] + 2 * z["e"] + z["se"]) - (z["nw"] + 2 * z["w"] + z["sw"])) / across
    gy = ((z["sw"] + 2 * z["s"] + z["se"]) - (z["nw"] + 2 * z["n"] + z["ne"])) / across
    return n.select(*PIXEL, V("c").alias("v"), gx.alias("gx"), gy.alias("gy"))


def _grey(field: Grid, df: DataFrame, share: Column) -> Grid:
    return field.with_df(df.select(*PIXEL, *[to_byte(share).alias(c) for c in "rgb"], F.lit(255).alias("a")))


def slope(field: Grid, max_deg: float = 90.0, invert: bool = False) -> Grid:
    """Steepness as grey, white at ``max_deg``; missing samples are transparent."""
    df = gradient(field).where("v IS NOT NULL")
    t = clamp(F.atan(F.sqrt(V("gx") * V("gx") + V("gy") * V("gy"))) / max(math.radians(max_deg), 1e-4), 0, 1)
    return _grey(field, df, 1 - t if invert else t)


def _shade(scale: float, altitude: float, azimuth: float, gx: Column, gy: Column) -> Column:
    zenith, turn = math.pi / 2 - math.radians(altitude), math.radians(450.0 - azimuth)
    dx, dy = gx * scale, gy * scale
    facing = -dx * math.cos(turn) + dy * math.sin(turn)
    return (math.cos(zenith) + math.sin(zenith) * facing) / F.sqrt(1 + dx * dx + dy * dy)


# Light directions and weights of the multidirectional shade.
DIRECTIONS = ((225.0, 1), (270.0, 2), (315.0, 2), (360.0, 1))


def hillshade(field: Grid, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, exaggeration: float = 1.0, multidirectional: bool = False, mode: str = "shade", shadow: str = "#000000", highlight: str | None = None) -> Grid:
    """Light on a slope; ``relief`` paints only what differs from flat ground, in two colours."""
    df, scale = gradient(field).where("v IS NOT NULL"), z_factor * exaggeration
    lights = [(a, w / 6) for a, w in DIRECTIONS] if multidirectional else [(azimuth, 1.0)]
    shade = lambda gx, gy: clamp(sum((w * _shade(scale, altitude, a, gx, gy) for a, w in lights[1:]), lights[0][1] * _shade(scale, altitude, lights[0][0], gx, gy)), 0, 1)
    df, now = df.withColumn("light", shade(V("gx"), V("gy"))), V("light")
    if mode == "shade":
        return _grey(field, df, now)
    flat = min(max(math.cos(math.pi / 2 - math.radians(altitude)), 0.0), 1.0)
    dark, light = color.parse(shadow), color.parse(highlight) if highlight else None
    under = F.lit(0.0) if flat <= 1e-6 else (flat - now) / flat
    over = F.lit(0.0) if light is None or flat >= 1 else (now - flat) / (1 - flat)
    below = now < flat
    alpha = clamp(F.when(below, under * dark[3]).otherwise(over * (light[3] if light else 0.0)), 0, 1)
    df, alpha = df.withColumn("cover", alpha), V("cover")
    tint = [F.when(below, F.lit(d)).otherwise(F.lit(l)) for d, l in zip(dark, light or (0.0,) * 4)][:3]
    return field.with_df(df.select(*PIXEL, *color.premultiplied(tint, alpha), to_byte(alpha).alias("a")))


def flow_field(field: Grid, direction: str = "downhill", max_deg: float = 45.0, exaggeration: float = 1.0, normalize: bool = False) -> Grid:
    """The direction of slope as colour: r and g are 0.5 + 0.5 * component; flat or missing is the middle."""
    df = gradient(field)
    gx, gy = (F.coalesce(V(c), F.lit(0.0)) * exaggeration for c in ("gx", "gy"))
    g = F.sqrt(gx * gx + gy * gy)
    length = F.lit(1.0) if normalize else F.least(F.atan(g) / max(math.radians(max_deg), 1e-4), F.lit(1.0))
    dx, dy = (F.coalesce(F.try_divide(-c, g) * length, F.lit(0.0)) for c in (gx, gy))
    vx, vy = {"downhill": (dx, dy), "uphill": (-dx, -dy), "along": (dy, -dx)}[direction]
    return field.with_df(df.select(*PIXEL, to_byte(0.5 + 0.5 * vx).alias("r"), to_byte(0.5 + 0.5 * vy).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a")))


def dem_decode(pixels: Grid, encoding: str = "terrarium", factors: tuple[float, float, float, float] | None = None) -> Grid:
    """Heights out of colour bytes: terrarium, mapbox, or own factors for r, g, b and a base."""
    known = {"terrarium": (256.0, 1.0, 1 / 256, -32768.0), "mapbox": (6553.6, 25.6, 0.1, -10000.0)}
    fr, fg, fb, base = factors or known[encoding]
    return pixels.select(v=V("r") * fr + V("g") * fg + V("b") * fb + base)


def dem(tiles: DataFrame, size: int, source: Grid | None, z: int, min_zoom: int = 0, max_zoom: int = 30) -> Grid:
    """A source's heights; unbound or outside its zooms, a field of zeros."""
    if source is not None and min_zoom <= z <= max_zoom:
        return source
    from .grid import lattice

    return Grid(lattice(tiles, size, size).withColumn("v", F.lit(0.0)), size, size)


# Sides that the line pieces of a cell run from and to, with what is above the level on their left. Corners
# are bits: nw 8, ne 4, se 2, sw 1; saddles whose mean is above the level count 16 more.
CASES = {
    1: ("sw",),
    2: ("es",),
    3: ("ew",),
    4: ("ne",),
    5: ("ne", "sw"),
    6: ("ns",),
    7: ("nw",),
    8: ("wn",),
    9: ("sn",),
    10: ("wn", "es"),
    11: ("en",),
    12: ("we",),
    13: ("se",),
    14: ("ws",),
    21: ("nw", "se"),
    26: ("en", "ws"),
}


def contour_levels(field: Grid, interval: float, base: float = 0.0, low: float | None = None, high: float | None = None, levels: list[float] | None = None, most: int = 1000) -> list[float]:
    """The levels a field crosses; more than ``most`` are an error."""
    if levels is not None:
        return sorted(levels)
    if interval <= 0:
        raise ValueError("interval must be positive")
    first, last = field.df.agg(F.min("v"), F.max("v")).first()
    if first is None:
        return []
    first, last = max(first, -math.inf if low is None else low), min(last, math.inf if high is None else high)
    k0, k1 = math.ceil((first - base) / interval), math.floor((last - base) / interval)
    if k1 - k0 + 1 > most:
        raise ValueError(f"{k1 - k0 + 1} levels; at most {most}")
    return [base + k * interval for k in range(k0, k1 + 1)]


def contour_segments(field: Grid, levels: list[float]) -> DataFrame:
    """(z, x, y, level, px, py, part, x0, y0, x1, y1): line pieces of each cell, their ends interpolated along its sides.

    A corner is inside above the level. Of a saddle the inside is connected if the corners' mean is above the level. Cells
    with a missing corner give nothing, nor do pieces without length.
    """
    n = neighbourhood(field).where((V("px") < field.width - 1) & (V("py") < field.height - 1))
    cells = n.select(*PIXEL, V("c").alias("a"), V("e").alias("b"), V("se").alias("d"), V("s").alias("f"))
    cells = cells.where("a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND f IS NOT NULL")
    rows = cells.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    bit = lambda c, w: F.when(V(c) > V("level"), w).otherwise(0)
    rows = rows.withColumn("case", bit("a", 8) + bit("b", 4) + bit("d", 2) + bit("f", 1)).where("case NOT IN (0, 15)")
    above = V("case").isin(5, 10) & ((V("a") + V("b") + V("d") + V("f")) / 4 > V("level"))
    rows = rows.withColumn("case", V("case") + F.when(above, 16).otherwise(0))
    t = lambda p, q: F.try_divide(V("level") - V(p), V(q) - V(p))
    at = lambda x, y: F.struct((V("px") + x).cast("double").alias("x"), (V("py") + y).cast("double").alias("y"))
    sides = F.create_map(F.lit("n"), at(t("a", "b"), 0), F.lit("e"), at(1, t("b", "d")), F.lit("s"), at(t("f", "d"), 1), F.lit("w"), at(0, t("a", "f")))
    known = F.create_map(*[c for case, pieces in CASES.items() for c in (F.lit(case), F.array(*map(F.lit, pieces)))])
    out = rows.withColumn("sides", sides).select(*PIXEL, "level", "sides", F.posexplode(known[V("case")]).alias("part", "piece"))
    end = lambda i: V("sides")[F.substring("piece", i, 1)]
    out = out.select(*PIXEL, "level", "part", end(1).alias("p"), end(2).alias("q")).where("p <> q")
    return out.select(*PIXEL, "level", "part", V("p.x").alias("x0"), V("p.y").alias("y0"), V("q.x").alias("x1"), V("q.y").alias("y1"))


def contour_lines(segments: DataFrame) -> DataFrame:
    """(z, x, y, level, line, i, vx, vy): segments of a tile and level chained end to end."""
    import pandas as pd

    def chain(key, pdf):
        ends: dict = {}
        lines = [((round(a, 9), round(b, 9)), (round(c, 9), round(d, 9))) for a, b, c, d in zip(pdf.x0, pdf.y0, pdf.x1, pdf.y1)]
        for i, (p, q) in enumerate(lines):
            ends.setdefault(p, []).append(i)
            ends.setdefault(q, []).append(i)
        free, rows, number = set(range(len(lines))), [], 0
        starts = sorted(p for p, own in ends.items() if len(own) == 1) + sorted(ends)
        for start in starts:
            while any(i in free for i in ends[start]):
                path = [start]
                while nexts := [i for i in ends[path[-1]] if i in free]:
                    free.discard(nexts[0])
                    p, q = lines[nexts[0]]
                    path.append(q if p == path[-1] else p)
                rows += [(*key, number, i, *p) for i, p in enumerate(path)]
                number += 1
        return pd.DataFrame(rows, columns=["z", "x", "y", "level", "line", "i", "vx", "vy"])

    return segments.groupBy(*TILE, "level").applyInPandas(chain, "z int, x int, y int, level double, line int, i int, vx double, vy double")
