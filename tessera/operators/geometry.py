"""Geometry operators on feature rows.

A feature row has its tile (z, x, y), ``feature_ix`` (order within the layer), properties as columns, and any of
``points`` array<P>, ``lines`` array<array<P>>, ``polygons`` array<array<array<P>>> (rings, the exterior first, unclosed)
with P = struct<x double, y double> in tile units, y down. Whole coordinates are rounded half away from zero after every
operator. Everything here is a function of one row, or a grouping by tile: nothing shuffles that does not pool features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mercator
from ..functions.arith import clamp
from .grid import TILE

V = F.col
EXTENT = 4096
P = "struct<x:double,y:double>"
SHAPES = {"points": f"array<{P}>", "lines": f"array<array<{P}>>", "polygons": f"array<array<array<{P}>>>"}


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def snapped(x: Column, y: Column) -> Column:
    return point(F.round(x), F.round(y))


def shape(df: DataFrame, name: str) -> Column:
    return F.coalesce(V(name), F.array().cast(SHAPES[name])) if name in df.columns else F.array().cast(SHAPES[name])


def mapped(df: DataFrame, of_point) -> DataFrame:
    """Every vertex of every shape through ``of_point``."""
    ring = lambda r: F.transform(r, of_point)
    out = {"points": lambda c: ring(c), "lines": lambda c: F.transform(c, ring), "polygons": lambda c: F.transform(c, lambda p: F.transform(p, ring))}
    return df.withColumns({n: f(V(n)) for n, f in out.items() if n in df.columns})


def _each_line(df: DataFrame, closed_too: bool, f) -> DataFrame:
    """Lines (and rings, if asked) through ``f(vertices, closed)``."""
    out = {}
    if "lines" in df.columns:
        out["lines"] = F.transform("lines", lambda r: f(r, False))
    if closed_too and "polygons" in df.columns:
        out["polygons"] = F.transform("polygons", lambda p: F.transform(p, lambda r: f(r, True)))
    return df.withColumns(out)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _segments(ring: Column, closed: bool) -> Column:
    """array<struct<a, b>> of neighbouring vertices."""
    ends = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)) if closed else F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    starts = ring if closed else F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _length(s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    return F.sqrt(dx * dx + dy * dy)


def _between(s: Column, t: Column) -> Column:
    return snapped(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * t, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * t)


def vertices(df: DataFrame, of: str = "lines") -> DataFrame:
    """Long form: a row per vertex with part, ring (polygons), i, vx, vy; other columns stay."""
    keep = [c for c in df.columns if c not in SHAPES]
    if of == "points":
        return df.select(*keep, F.posexplode(of).alias("i", "p")).select(*keep, "i", V("p.x").alias("vx"), V("p.y").alias("vy"))
    rows = df.select(*keep, F.posexplode(of).alias("part", "s"))
    if of == "polygons":
        rows, keep = rows.select(*keep, "part", F.posexplode("s").alias("ring", "s")), [*keep, "part", "ring"]
    else:
        keep = [*keep, "part"]
    return rows.select(*keep, F.posexplode("s").alias("i", "p")).select(*keep, "i", V("p.x").alias("vx"), V("p.y").alias("vy"))


def every_vertex(df: DataFrame) -> DataFrame:
    """Long form of points, lines and polygons in one pass: of_, part (points: 0), i, vx, vy; other columns stay."""
    keep = [c for c in df.columns if c not in SHAPES]

    def line(of: str, ps: Column, part: Column) -> Column:
        return F.transform(ps, lambda p, i: F.struct(F.lit(of).alias("of_"), part.cast("int").alias("part"), i.cast("int").alias("i"), p["x"].alias("vx"), p["y"].alias("vy")))

    lines = F.flatten(F.transform(shape(df, "lines"), lambda r, part: line("lines", r, part)))
    polygons = F.flatten(F.flatten(F.transform(shape(df, "polygons"), lambda rs, part: F.transform(rs, lambda r: line("polygons", r, part)))))
    every = F.concat(line("points", shape(df, "points"), F.lit(0)), lines, polygons)
    return df.select(*keep, F.explode(every).alias("v")).select(*keep, "v.of_", "v.part", "v.i", "v.vx", "v.vy")


# Sources


def literal_geometry(spark, points=(), lines=(), polygons=(), z: int = 0, x: int = 0, y: int = 0) -> DataFrame:
    """One feature without properties out of plain coordinates; ``polygons`` are lists of rings."""
    row = (z, x, y, 0, [(float(a), float(b)) for a, b in points], [[(float(a), float(b)) for a, b in r] for r in lines], [[[(float(a), float(b)) for a, b in r] for r in p] for p in polygons])
    return spark.createDataFrame([row], f"z int, x int, y int, feature_ix long, points {SHAPES['points']}, lines {SHAPES['lines']}, polygons {SHAPES['polygons']}")


def rectangle(x0, y0, x1, y1) -> Column:
    x0, y0, x1, y1 = (c if isinstance(c, Column) else F.lit(float(c)) for c in (x0, y0, x1, y1))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def tile_bounds(tiles: DataFrame, cover: str = "tile", pad: int = 0, tile_px: int = 512, extent: int = EXTENT) -> DataFrame:
    """A tile as one rectangle; ``canvas`` adds the padding."""
    m = math.ceil(pad * extent / tile_px) if cover == "canvas" else 0
    return tiles.select(*TILE, F.lit(0).cast("long").alias("feature_ix"), F.array(F.array(rectangle(-m, -m, extent + m, extent + m))).alias("polygons"))


def point_grid(tiles: DataFrame, spacing_x: float, spacing_y: float | None = None, stagger: float = 0.0, offset: tuple[float, float] = (0.0, 0.0), anchor: str = "world", extent: int = EXTENT) -> DataFrame:
    """A lattice over each tile, one row per point; odd rows shift by ``stagger`` of a step. No spacing, no points."""
    spacing_y = spacing_x if spacing_y is None else spacing_y
    if spacing_x <= 0 or spacing_y <= 0:
        return tiles.where(F.lit(False)).select(*TILE, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    ox, oy = (V(t) * extent if anchor == "world" else F.lit(0) for t in ("x", "y"))
    rows = tiles.select(*TILE, F.explode(F.sequence(F.ceil((oy - offset[1]) / spacing_y), F.ceil((oy + extent - offset[1]) / spacing_y) - 1)).alias("j"))
    shift = offset[0] + F.pmod(V("j"), F.lit(2)) * (stagger * spacing_x)
    rows = rows.select(*TILE, "j", F.explode(F.sequence(F.ceil((ox - shift) / spacing_x), F.ceil((ox + extent - shift) / spacing_x) - 1)).alias("i"))
    return rows.select(*TILE, "i", "j", F.round(V("i") * spacing_x + shift - ox).alias("vx"), F.round(V("j") * spacing_y + offset[1] - oy).alias("vy"))


def _cell_draw(salt: int, k: int) -> Column:
    from .raster import cell_hash

    return cell_hash(V("i") + 1, V("j") + 1, F.lit(k), salt=salt) / 2147483647


def point_scatter(tiles: DataFrame, spacing_x: float, spacing_y: float | None = None, seed: int = 0, extent: int = EXTENT) -> DataFrame:
    """0 to 3 points per world cell (6, 6, 2, 2 of 16), placed evenly in it: a function of cell and seed alone."""
    spacing_y = spacing_x if spacing_y is None else spacing_y
    cells = lambda t, s: F.sequence(F.floor(V(t) * extent / s), F.floor(((V(t) + 1) * extent - 1e-9) / s))
    rows = tiles.select(*TILE, F.explode(cells("y", spacing_y)).alias("j")).select(*TILE, "j", F.explode(cells("x", spacing_x)).alias("i"))
    u = _cell_draw(seed, 0) * 16
    rows = rows.withColumn("n", F.when(u < 6, 0).when(u < 12, 1).when(u < 14, 2).otherwise(3)).where("n > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), V("n"))))
    from .raster import cell_hash

    at = lambda c, s, o: (V(c) + cell_hash(V("i") + 1, V("j") + 1, V("k") * 2 + o, salt=seed) / 2147483647) * s
    rows = rows.select(*TILE, "i", "j", "k", F.round(at("i", spacing_x, 1) - V("x") * extent).alias("vx"), F.round(at("j", spacing_y, 2) - V("y") * extent).alias("vy"))
    return rows.where(V("vx").between(0, extent - 1) & V("vy").between(0, extent - 1))


# The steps of an automatic graticule, in degrees.
LADDER = (30.0, 10.0, 5.0, 2.0, 1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 5e-4, 2e-4, 1e-4, 5e-5, 2e-5, 1e-5, 5e-6, 2e-6, 1e-6)


def graticule_step(z: int) -> float:
    """About four lines per tile."""
    target = 360 / 2**z / 4
    return next((s for s in LADDER if s <= target), LADDER[-1])


def graticule(tiles: DataFrame, interval_x: float, interval_y: float, axes: str = "both", extent: int = EXTENT) -> DataFrame:
    """Meridians and parallels crossing each tile, as ends (x0, y0, x1, y1) with axis, degrees and label."""
    n = F.pow(F.lit(2.0), V("z"))
    lon = lambda d: mercator.longitude((V("x") + d) / n)
    lat = lambda d: mercator.latitude((V("y") + d) / n)
    lines = lambda low, high, step: F.explode(F.sequence(F.ceil(F.round(low / step, 9)), F.floor(F.round(high / step, 9))))
    some = lambda low, high, step: F.ceil(F.round(low / step, 9)) <= F.floor(F.round(high / step, 9))
    east = tiles.where(some(lon(0), lon(1), interval_x)).select(*TILE, F.lit("meridian").alias("axis"), lines(lon(0), lon(1), interval_x).alias("k")).withColumn("degrees", V("k") * interval_x)
    north = tiles.where(some(lat(1), lat(0), interval_y)).select(*TILE, F.lit("parallel").alias("axis"), lines(lat(1), lat(0), interval_y).alias("k")).withColumn("degrees", V("k") * interval_y)
    rows = {"both": lambda: east.unionAll(north), "meridians": lambda: east, "parallels": lambda: north}[axes]()
    mx = F.round((mercator.world_x(V("degrees")) * n - V("x")) * extent)
    my = F.round((mercator.world_y(V("degrees")) * n - V("y")) * extent)
    e = V("axis") == "meridian"
    side = F.when(F.abs("degrees") < 5e-7, "").when(e & (V("degrees") > 0), "E").when(e, "W").when(V("degrees") > 0, "N").otherwise("S")
    label = F.concat(F.regexp_replace(F.format_string("%.6f", F.abs("degrees")), r"\.?0+$", ""), F.lit("°"), side)
    return rows.select(*TILE, "axis", "degrees", label.alias("label"), F.when(e, mx).otherwise(0.0).alias("x0"), F.when(e, 0.0).otherwise(my).alias("y0"), F.when(e, mx).otherwise(float(extent)).alias("x1"), F.when(e, float(extent)).otherwise(my).alias("y1"))


# Scan


def features(df: DataFrame, z: int | None = None, where: Column | None = None, min_zoom: int | None = None, max_zoom: int | None = None, min_zoom_field: str | None = None) -> DataFrame:
    """Scan of one layer: out of the zoom band it is empty, whatever the source; a filter that fails drops the row."""
    if z is not None and ((min_zoom is not None and z < min_zoom) or (max_zoom is not None and z > max_zoom)):
        return df.where(F.lit(False))
    if z is None:
        df = df.where(V("z") >= min_zoom) if min_zoom is not None else df
        df = df.where(V("z") <= max_zoom) if max_zoom is not None else df
    if where is not None:
        df = df.where(F.coalesce(where, F.lit(False)))
    if min_zoom_field:
        df = df.where(F.coalesce(V(min_zoom_field).cast("double") <= (F.lit(z) if z is not None else V("z")), F.lit(True)))
    shapes = [n for n in SHAPES if n in df.columns]
    some = None
    for n in shapes:
        here = F.coalesce(F.size(n), F.lit(0)) > 0
        some = here if some is None else some | here
    return df if some is None else df.where(some)


def stitched(df: DataFrame, extent: int = EXTENT) -> DataFrame:
    """Each row in its own tile and, moved, in the eight around it (dx, dy say where it came from); x wraps, y stops."""
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = df.withColumn("o", F.explode(offsets)).withColumns({"dx": V("o.dx"), "dy": V("o.dy")}).drop("o")
    n = F.pow(F.lit(2), V("z")).cast("int")
    rows = rows.withColumns({"x": F.pmod(V("x") - V("dx"), n), "y": V("y") - V("dy")}).where((V("y") >= 0) & (V("y") < n))
    return mapped(rows, lambda p: point(p["x"] + V("dx") * extent, p["y"] + V("dy") * extent))


def overzoomed(df: DataFrame, z: int, extent: int = EXTENT) -> DataFrame:
    """Features of ancestor tiles in the frames of the tiles at ``z`` that their boxes touch; nothing is clipped."""
    k = F.pow(F.lit(2), F.lit(z) - V("z")).cast("int")
    b = _box_of(df)
    rows = df.withColumns({"k": k, **b})
    span = lambda lo, hi: F.sequence(F.greatest(F.floor(V(lo) * V("k") / extent).cast("int"), F.lit(0)), F.least(F.floor(V(hi) * V("k") / extent).cast("int"), V("k") - 1))
    inside = (V("b1") >= 0) & (V("b0") <= extent) & (V("b3") >= 0) & (V("b2") <= extent)
    rows = rows.where(inside).withColumn("i", F.explode(span("b0", "b1"))).withColumn("j", F.explode(span("b2", "b3")))
    rows = mapped(rows, lambda p: snapped(p["x"] * V("k") - V("i") * extent, p["y"] * V("k") - V("j") * extent))
    return rows.withColumns({"x": V("x") * V("k") + V("i"), "y": V("y") * V("k") + V("j"), "z": F.lit(z)}).drop("i", "j", "k", *b)


def _all_vertices(df: DataFrame) -> Column:
    return F.concat(shape(df, "points"), F.flatten(shape(df, "lines")), F.flatten(F.flatten(shape(df, "polygons"))))


def _box_of(df: DataFrame) -> dict[str, Column]:
    xs, ys = F.transform(_all_vertices(df), lambda p: p["x"]), F.transform(_all_vertices(df), lambda p: p["y"])
    return {"b0": F.array_min(xs), "b1": F.array_max(xs), "b2": F.array_min(ys), "b3": F.array_max(ys)}


def culled(df: DataFrame, influence: float, extent: int = EXTENT) -> DataFrame:
    """Only features whose boxes come within ``influence`` units of the tile."""
    b = _box_of(df)
    rows = df.withColumns(b)
    return rows.where((V("b1") >= -influence) & (V("b0") <= extent + influence) & (V("b3") >= -influence) & (V("b2") <= extent + influence)).drop(*b)


# One feature at a time


def boundary(df: DataFrame, clip_edges: str = "keep", extent: int = EXTENT) -> DataFrame:
    """Rings as closed lines, exterior then holes; ``drop`` takes out segments along the tile's clip outside of it."""
    rings = F.transform(F.flatten(shape(df, "polygons")), lambda r: F.concat(r, F.slice(r, 1, 1)))
    out = df.withColumn("lines", F.concat(shape(df, "lines"), rings)).drop("polygons")
    if clip_edges == "keep":
        return out
    steep = math.tan(math.radians(15))

    def along_clip(s: Column) -> Column:
        (ax, ay), (bx, by) = ((s[e]["x"], s[e]["y"]) for e in "ab")
        dx, dy = F.abs(bx - ax), F.abs(by - ay)
        beyond = lambda a, b: ((a < 0) & (b < 0)) | ((a > extent) & (b > extent))
        return (beyond(ax, bx) & (dx <= dy * steep)) | (beyond(ay, by) & (dy <= dx * steep))

    def kept_runs(line: Column) -> Column:
        none = F.array().cast(SHAPES["lines"])

        def step(acc: Column, s: Column) -> Column:
            grow = F.concat(acc["now"], F.when(F.size(acc["now"]) == 0, F.array(s["a"], s["b"])).otherwise(F.array(s["b"])))
            done = F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
            cut = along_clip(s)
            return F.struct(F.when(cut, done).otherwise(acc["done"]).alias("done"), F.when(cut, F.array().cast(SHAPES["points"])).otherwise(grow).alias("now"))

        start = F.struct(none.alias("done"), F.array().cast(SHAPES["points"]).alias("now"))
        return F.aggregate(_segments(line, False), start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))

    return out.withColumn("lines", F.flatten(F.transform("lines", kept_runs)))


def ring_moments(ring: Column) -> Column:
    """Twice the signed area and the first moments, measured from the first vertex."""
    o = ring[0]

    def add(acc: Column, s: Column) -> Column:
        x0, y0, x1, y1 = s["a"]["x"] - o["x"], s["a"]["y"] - o["y"], s["b"]["x"] - o["x"], s["b"]["y"] - o["y"]
        c = x0 * y1 - x1 * y0
        return F.struct((acc["a2"] + c).alias("a2"), (acc["mx"] + (x0 + x1) * c).alias("mx"), (acc["my"] + (y0 + y1) * c).alias("my"))

    return F.aggregate(_segments(ring, True), F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")), add)


def ring_centroid(ring: Column) -> Column:
    """Centre of area; of a ring without area, the mean of its vertices; of fewer than three vertices, null."""

    def done(m: Column) -> Column:
        n = F.size(ring)
        mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / n
        flat = m["a2"] == 0
        c = lambda k, mk: F.when(flat, mean(k)).otherwise(F.try_divide(m[mk], 3 * m["a2"]) + ring[0][k])
        return F.when(n >= 3, snapped(c("x", "mx"), c("y", "my")))

    return F.transform(F.array(ring_moments(ring)), done)[0]


def line_centroid(line: Column) -> Column:
    """Mean of the segments' middles by length; null without length."""

    def add(acc: Column, s: Column) -> Column:
        l = _length(s)
        return F.struct((acc["l"] + l).alias("l"), (acc["x"] + (s["a"]["x"] + s["b"]["x"]) / 2 * l).alias("x"), (acc["y"] + (s["a"]["y"] + s["b"]["y"]) / 2 * l).alias("y"))

    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    mean = F.aggregate(_segments(line, False), zero, add, lambda a: F.when(a["l"] > 0, snapped(F.try_divide(a["x"], a["l"]), F.try_divide(a["y"], a["l"]))))
    return F.when(F.size(line) == 1, line[0]).otherwise(mean)


def centroid(df: DataFrame, include_polygons: bool = True, include_lines: bool = True) -> DataFrame:
    """Points at the middles of polygons (exteriors alone count) and lines; points of the input go, properties stay."""
    found = []
    if include_polygons:
        found.append(F.transform(shape(df, "polygons"), lambda p: ring_centroid(p[0])))
    if include_lines:
        found.append(F.transform(shape(df, "lines"), line_centroid))
    out = df.withColumn("points", F.filter(F.concat(*found), lambda p: p.isNotNull())).drop("lines", "polygons")
    return out.where(F.size("points") > 0)


def transform(df: DataFrame, scale: tuple[float, float] = (1.0, 1.0), rotation_deg: float = 0.0, translate: tuple[float, float] = (0.0, 0.0), pivot: tuple[float, float] = (EXTENT / 2, EXTENT / 2)) -> DataFrame:
    """Scale, turn, then move every vertex, about ``pivot``."""
    c, s = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))

    def one(p: Column) -> Column:
        x, y = (p["x"] - pivot[0]) * scale[0], (p["y"] - pivot[1]) * scale[1]
        return snapped(x * c - y * s + pivot[0] + translate[0], x * s + y * c + pivot[1] + translate[1])

    return mapped(df, one)


def smooth(df: DataFrame, iterations: int = 1) -> DataFrame:
    """Corner cutting at quarters; open lines keep their ends."""

    def once(r: Column, closed: bool) -> Column:
        cut = F.flatten(F.transform(_segments(r, closed), lambda s: F.array(_between(s, F.lit(0.25)), _between(s, F.lit(0.75)))))
        out = cut if closed else F.concat(F.slice(r, 1, 1), cut, F.slice(r, -1, 1))
        return F.when(F.size(r) >= 3, out).otherwise(r)

    for _ in range(iterations):
        df = _each_line(df, True, once)
    return df


def densify(df: DataFrame, target: float) -> DataFrame:
    """Segments longer than ``target`` split evenly; given vertices stay."""
    if target <= 0:
        return df

    def split(s: Column) -> Column:
        steps = F.greatest(F.ceil(_length(s) / target), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.when(k == 0, s["a"]).otherwise(_between(s, k / steps)))

    def line(r: Column, closed: bool) -> Column:
        out = F.flatten(F.transform(_segments(r, closed), split))
        return F.when(F.size(r) >= 2, out if closed else F.concat(out, F.slice(r, -1, 1))).otherwise(r)

    return _each_line(df, True, line)


def _measured(r: Column, closed: bool = False) -> Column:
    """Segments with the distance at which they begin (at) and their length (l)."""
    segments = F.transform(_segments(r, closed), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), _length(s).alias("l")))
    empty = F.struct(F.lit(0.0).alias("at"), F.array().cast(f"array<struct<a:{P},b:{P},l:double,at:double>>").alias("out"))
    grow = lambda acc, s: F.struct((acc["at"] + s["l"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"), s["l"].alias("l"), acc["at"].alias("at")))).alias("out"))
    return F.aggregate(segments, empty, grow, lambda acc: acc["out"])


def resample(df: DataFrame, spacing: float) -> DataFrame:
    """Vertices at even steps of length, the step adjusted to fit; shorter lines than a step stay."""
    if spacing <= 0:
        return df

    def line(r: Column, closed: bool) -> Column:
        def spread(m: Column) -> Column:
            return _let(F.aggregate(m, F.lit(0.0), lambda t, s: t + s["l"]), lambda total: placed(m, total))

        def placed(m: Column, total: Column) -> Column:
            n = F.round(total / spacing).cast("int")
            step = total / F.greatest(n, F.lit(1))
            k0 = lambda s: F.floor(s["at"] / step + 1e-12).cast("int") + 1
            k1 = lambda s: F.least(F.floor((s["at"] + s["l"]) / step + 1e-12).cast("int"), n - 1)
            inner = F.flatten(F.transform(m, lambda s: F.when(k1(s) >= k0(s), F.transform(F.sequence(k0(s), k1(s)), lambda k: _between(s, (k * step - s["at"]) / s["l"]))).otherwise(F.array().cast(SHAPES["points"]))))
            out = F.concat(F.slice(r, 1, 1), inner)
            if not closed:
                out = F.when(F.element_at(out, -1) == F.element_at(r, -1), out).otherwise(F.concat(out, F.slice(r, -1, 1)))
            return F.when((total >= spacing) & (n >= 2), out).otherwise(r)

        return F.when(F.size(r) >= 2, F.transform(F.array(_measured(r, closed)), spread)[0]).otherwise(r)

    return _each_line(df, True, line)


def dash(df: DataFrame, on: float, off: float, phase: float = 0.0) -> DataFrame:
    """Lines cut by length into pieces of ``on`` with gaps of ``off``; rounded vertices that repeat are one."""
    if on <= 0:
        return df.withColumn("lines", F.array().cast(SHAPES["lines"]))
    if off <= 0:
        return df
    period = on + off
    first = phase - period * math.floor(phase / period)

    empty = F.array().cast(SHAPES["points"])

    def runs(s: Column) -> Column:
        """array<struct<k, a, b>>: the ends of the stretches of one segment that lie on, with the number of their piece."""
        low, high = s["at"] + first, s["at"] + s["l"] + first
        ks = F.sequence(F.floor((low - on) / period).cast("int"), F.floor(high / period).cast("int"))
        at = lambda d: _between(s, F.try_divide(F.least(F.greatest(d, s["at"]), s["at"] + s["l"]) - s["at"], s["l"]))
        one = lambda k: F.struct(k.alias("k"), at(k * period - first).alias("a"), at(k * period - first + on).alias("b"))
        met = lambda k: (k * period + on > low + 1e-9) & (k * period < high - 1e-9)
        return F.transform(F.filter(ks, met), one)

    def step(acc: Column, s: Column) -> Column:
        tail = F.when(s["a"] == s["b"], F.array(s["a"])).otherwise(F.array(s["a"], s["b"]))
        more = lambda p: F.when(F.element_at(acc["now"], -1) == p, empty).otherwise(F.array(p))
        grown = F.concat(acc["now"], more(s["a"]), F.when(s["a"] == s["b"], empty).otherwise(F.array(s["b"])))
        same = acc["k"] == s["k"]
        done = F.when(same | (F.size(acc["now"]) == 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(s["k"].alias("k"), F.when(same, grown).otherwise(tail).alias("now"), done.alias("done"))

    def line(r: Column) -> Column:
        stretches = F.flatten(F.transform(F.filter(_measured(r), lambda s: s["l"] > 0), runs))
        start = F.struct(F.lit(-1 << 31).alias("k"), empty.alias("now"), F.array().cast(SHAPES["lines"]).alias("done"))
        joined = F.aggregate(stretches, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
        return F.when(F.size(r) >= 2, joined).otherwise(F.array().cast(SHAPES["lines"]))

    return df.withColumn("lines", F.flatten(F.transform("lines", line)))


def wave(df: DataFrame, amplitude: float, wavelength: float, phase: float = 0.0, samples: int = 8) -> DataFrame:
    """Lines swung sideways by a sine of the distance along them."""
    step = wavelength / samples

    def line(r: Column) -> Column:
        def swing(m: Column) -> Column:
            def along(s: Column) -> Column:
                ks = F.sequence(F.ceil(s["at"] / step).cast("int"), F.greatest(F.ceil((s["at"] + s["l"]) / step).cast("int") - 1, F.ceil(s["at"] / step).cast("int")))

                def one(k: Column) -> Column:
                    t = (k * step - s["at"]) / s["l"]
                    side = F.sin((k * step + phase) * (2 * math.pi / wavelength)) * amplitude
                    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
                    return snapped(s["a"]["x"] + dx * t - dy / s["l"] * side, s["a"]["y"] + dy * t + dx / s["l"] * side)

                inside = F.filter(ks, lambda k: k * step < s["at"] + s["l"])
                return F.transform(inside, one)

            return F.flatten(F.transform(F.filter(m, lambda s: s["l"] > 0), along))

        return F.transform(F.array(_measured(r)), swing)[0]

    return df.withColumn("lines", F.filter(F.transform("lines", line), lambda r: F.size(r) >= 2))


def _inside(rings: Column, x: Column, y: Column) -> Column:
    """Ray casting over all rings of a polygon: inside a hole is outside."""

    def crosses(s: Column) -> Column:
        ay, by = s["a"]["y"], s["b"]["y"]
        at = s["a"]["x"] + F.try_divide((y - ay) * (s["b"]["x"] - s["a"]["x"]), by - ay)
        return F.when((ay > y) != (by > y), F.when(x < at, 1).otherwise(0)).otherwise(0)

    edges = F.flatten(F.transform(rings, lambda r: _segments(r, True)))
    return F.aggregate(edges, F.lit(0), lambda n, s: n + crosses(s)) % 2 == 1


def contains(df: DataFrame, x: Column, y: Column) -> Column:
    """Whether a place lies in any of the row's polygons."""
    return F.exists(shape(df, "polygons"), lambda p: _inside(p, x, y))


def hatch(df: DataFrame, angle_deg: float, spacing: float, phase: float = 0.0, extent: int = EXTENT) -> DataFrame:
    """Parallel lines clipped to each polygon, even-odd; the family is anchored in the world, so tiles join up."""
    if spacing <= 0:
        return df.where(F.lit(False))
    s, c = math.sin(math.radians(angle_deg)), math.cos(math.radians(angle_deg))
    origin = V("y") * (extent * c) - V("x") * (extent * s)

    def turned(rings: Column) -> Column:
        return F.transform(rings, lambda r: F.transform(r, lambda p: point(p["x"] * c + p["y"] * s, p["y"] * c - p["x"] * s)))

    def polygon(rings: Column) -> Column:
        edges = F.flatten(F.transform(rings, lambda r: _segments(r, True)))
        return _let(F.struct(edges.alias("edges"), F.transform(rings[0], lambda p: p["y"]).alias("vs")), lines)

    def lines(held: Column) -> Column:
        low, high = F.array_min(held["vs"]), F.array_max(held["vs"])
        ks = F.sequence(F.floor((low + origin) / spacing - phase), F.ceil((high + origin) / spacing - phase))

        def line(k: Column) -> Column:
            v = (k + phase) * spacing - origin
            hits = F.filter(held["edges"], lambda e: (e["a"]["y"] > v) != (e["b"]["y"] > v))
            across = lambda e: e["a"]["x"] + (v - e["a"]["y"]) * F.try_divide(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
            return _let(F.array_sort(F.transform(hits, across)), lambda us: stretches(us, v))

        def stretches(us: Column, v: Column) -> Column:
            back = lambda u: snapped(u * c - v * s, u * s + v * c)
            pair = lambda u, i: F.struct(i.alias("i"), u.alias("u"), F.get(us, i + 1).alias("w"))
            pairs = F.filter(F.transform(us, pair), lambda q: (q["i"] % 2 == 0) & q["w"].isNotNull() & (q["w"] > q["u"]))
            return F.transform(pairs, lambda q: F.array(back(q["u"]), back(q["w"])))

        return F.when(high > low, F.flatten(F.transform(ks, line))).otherwise(F.array().cast(SHAPES["lines"]))

    return df.withColumn("lines", F.flatten(F.transform("polygons", lambda p: _let(turned(p), polygon)))).drop("polygons", "points")


def dot_density(df: DataFrame, density: Column | float, dot_value: float = 1.0, spacing: float = 64.0, jitter: float = 1.0, seed: int = 0, extent: int = EXTENT) -> DataFrame:
    """Dots in polygons, at most one per world cell, kept with the share of a dot that its ground area is worth.

    Polygons are exploded to the cells of their boxes; whether a cell's dot stays depends on cell, row and seed alone.
    """
    per_km2 = (density if isinstance(density, Column) else F.lit(float(density))) / dot_value
    b = _box_of(df)
    rows = df.withColumns({**b, "per_km2": per_km2}).where("per_km2 > 0")
    cells = lambda t, lo, hi: F.sequence(F.floor((V(lo) + V(t) * extent) / spacing), F.floor((V(hi) + V(t) * extent) / spacing))
    rows = rows.withColumn("j", F.explode(cells("y", "b2", "b3")))
    n = F.pow(F.lit(2.0), V("z"))
    m = mercator.metres_per_unit(V("z"), clamp((V("j") + 0.5) * spacing / (n * extent), 0, 1), extent)
    rows = rows.withColumn("keep", F.least(V("per_km2") * F.pow(m / 1000, F.lit(2)) * spacing**2, F.lit(1.0))).where("keep > 0")
    rows = rows.withColumn("i", F.explode(cells("x", "b0", "b1"))).where(_cell_draw(seed, 3) < V("keep"))
    at = lambda c, k, t: (V(c) + 0.5 + (_cell_draw(seed, k) - 0.5) * min(max(jitter, 0), 1)) * spacing - V(t) * extent
    rows = rows.withColumns({"vx": at("i", 1, "x"), "vy": at("j", 2, "y")})
    rows = rows.where(contains(rows, V("vx"), V("vy")))
    return rows.withColumns({"vx": F.round("vx"), "vy": F.round("vy")}).drop("lines", "polygons", "points", "per_km2", "keep", *b)


def segment_to(df: DataFrame, lng: Column, lat: Column, gap: float = 0.0, extent: int = EXTENT) -> DataFrame:
    """A line (x0, y0, x1, y1) from a place in degrees to each point, its end pulled back by ``gap``."""
    ok = lng.between(-180, 180) & lat.between(-90, 90)
    n = F.pow(F.lit(2.0), V("z"))
    rows = df.where(F.coalesce(ok, F.lit(False))).withColumns({"x0": F.round((mercator.world_x(lng) * n - V("x")) * extent), "y0": F.round((mercator.world_y(lat) * n - V("y")) * extent)})
    rows = rows.withColumn("p", F.explode("points"))
    dx, dy = V("p.x") - V("x0"), V("p.y") - V("y0")
    l = F.sqrt(dx * dx + dy * dy)
    rows = rows.where(l > gap).withColumns({"x1": F.round(V("x0") + dx * F.try_divide(l - gap, l)), "y1": F.round(V("y0") + dy * F.try_divide(l - gap, l))})
    return rows.where("x1 <> x0 OR y1 <> y0").drop("p", *[c for c in SHAPES if c in df.columns])


def disc(p: Column, distance: float, join: str = "round") -> Column:
    """A point as a polygon of one ring."""
    n = max(8, math.ceil(2 * math.pi / 0.25)) if join == "round" else 32
    r, step = abs(distance), 2 * math.pi / n
    corners = F.sequence(F.lit(0), F.lit(n - 1))
    return F.array(F.transform(corners, lambda i: snapped(p["x"] + r * F.cos(i * step), p["y"] + r * F.sin(i * step))))


def buffer_points(df: DataFrame, distance: float, join: str = "round") -> DataFrame:
    """Points as regular polygons around them."""
    return df.withColumn("polygons", F.transform("points", lambda p: disc(p, distance, join))).drop("points", "lines")


# Pools of a tile's features


def bbox(df: DataFrame) -> DataFrame:
    """One rectangle around all vertices of a tile; combined before the shuffle."""
    b = _box_of(df)
    rows = df.select(*TILE, *[c.alias(n) for n, c in b.items()]).where("b0 IS NOT NULL")
    return rows.groupBy(*TILE).agg(F.min("b0").alias("x0"), F.min("b2").alias("y0"), F.max("b1").alias("x1"), F.max("b3").alias("y1"))


def junctions(df: DataFrame, snap: float = 0.0) -> DataFrame:
    """(z, x, y, vx, vy, arms, axis_deg): where line ends of a tile meet, how many, and the axis of a tick across them.

    Ends within ``snap`` of each other, also by way of others, are one junction at their mean. The axis, in [0, 180), lies
    across a single arm or a straight line, else along the bisector of the arms; if that comes within 20 degrees of an arm,
    or two arms within 40 of each other, it lies in the middle of the widest gap between arms. Equal directions (to a
    thousandth of a degree) count once for gaps, so that what is gathered of a place stays small.
    """
    arms = lambda s: F.struct(s["a"].alias("p"), F.degrees(F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"])).alias("t"))
    turned = lambda s: F.struct(s["b"].alias("a"), s["a"].alias("b"))
    moving = lambda r: F.filter(_segments(r, False), lambda s: s["a"] != s["b"])
    two = lambda m: F.when(F.size(m) > 0, F.array(arms(m[0]), arms(turned(F.element_at(m, -1)))))
    ends = F.flatten(F.filter(F.transform("lines", lambda r: _let(moving(r), two)), lambda e: e.isNotNull()))
    rows = df.select(*TILE, F.explode(ends).alias("e")).select(*TILE, V("e.p.x").alias("vx"), V("e.p.y").alias("vy"), V("e.t").alias("t"))
    place = ["vx", "vy"]
    if snap > 0:
        rows, place = rows.join(_merged_places(rows, snap), [*TILE, "vx", "vy"]), ["g"]
    turn = F.radians("t")
    out = rows.groupBy(*TILE, *place).agg(
        F.avg("vx").alias("mx"),
        F.avg("vy").alias("my"),
        F.count(F.lit(1)).alias("arms"),
        F.sum(F.cos(turn)).alias("c"),
        F.sum(F.sin(turn)).alias("s"),
        F.array_sort(F.collect_set(F.pmod(F.round("t", 3), F.lit(360.0)))).alias("ts"),
    )
    after = F.transform("ts", lambda t, i: F.struct((F.coalesce(F.get("ts", i + 1), V("ts")[0] + 360) - t).alias("gap"), (-t).alias("from")))
    out = out.withColumns({"widest": F.array_max(after), "least": F.array_min(after)["gap"]})
    bisector = F.degrees(F.atan2("s", "c"))
    near_arm = F.exists("ts", lambda t: F.abs(F.pmod(t - bisector + 180, F.lit(360.0)) - 180) < 20)
    straight = V("c") * V("c") + V("s") * V("s") < 1e-6
    middle = -V("widest.from") + V("widest.gap") / 2
    axis = F.when(V("arms") == 1, V("ts")[0] + 90).when(straight, V("ts")[0] + 90).when(near_arm | (V("least") < 40), middle).otherwise(bisector)
    return out.select(*TILE, F.round("mx").alias("vx"), F.round("my").alias("vy"), "arms", F.pmod(axis, F.lit(180.0)).alias("axis_deg"))


def _merged_places(rows: DataFrame, snap: float) -> DataFrame:
    """(tile, vx, vy, g): a number for each group of a tile's places that are within ``snap`` of each other, chained."""
    import numpy as np
    import pandas as pd

    def run(key, pdf):
        xy = pdf[["vx", "vy"]].to_numpy()
        cells: dict = {}
        for i, (cx, cy) in enumerate(np.floor(xy / snap).astype(int).tolist()):
            cells.setdefault((cx, cy), []).append(i)
        root = list(range(len(xy)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (cx, cy), own in cells.items():
            near = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ())])
            for i in own:
                for j in near[((xy[near] - xy[i]) ** 2).sum(1) <= snap * snap]:
                    a, b = top(i), top(int(j))
                    root[max(a, b)] = min(a, b)
        return pdf.assign(g=[top(i) for i in range(len(xy))])

    places = rows.select(*TILE, "vx", "vy").distinct()
    return places.groupBy(*TILE).applyInPandas(run, "z int, x int, y int, vx double, vy double, g int")


def nearest_seed(df: DataFrame, seeds: DataFrame, aspect: float = 1.0, per_cell: int = 4, extent: int = EXTENT) -> DataFrame:
    """Each point row (vx, vy) with the nearest seed (seed_ix, sx, sy) of its tile; ties to the smaller seed.

    Vertical distance counts ``aspect`` times. Points look into their cell of the tile and the eight around it; those whose
    best lies beyond what these surely cover look again in cells four times as wide, up to the whole tile. It is seeds that are
    shown in nine cells: a point is shuffled once a level. The finest cells
    hold about ``per_cell`` seeds in the fullest tile; seeds at one place are one, as are points equal in all columns. Tiles
    without seeds give no row.
    """
    places = seeds.groupBy(*TILE, "sx", "sy").agg(F.min("seed_ix").alias("seed_ix"))
    most = places.groupBy(*TILE).count().agg(F.max("count")).first()[0] or 0
    levels = max(1, math.ceil(math.log2(max(most / per_cell, 1)) / 4) + 1)
    keys = [c for c in df.columns if c not in ("seed_ix", "sx", "sy")]
    left, found = df.select(*keys), None
    stretch = min(1.0, aspect)
    for level in range(levels):
        side = extent / 4 ** (levels - 1 - level)
        last = level == levels - 1
        cell = lambda c, s=side, whole=last: F.lit(0) if whole else F.floor(V(c) / s)
        around = F.array(F.lit(0)) if last else F.array(F.lit(-1), F.lit(0), F.lit(1))
        held = places.withColumns({"ax": cell("sx"), "ay": cell("sy")}).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        held = held.withColumns({"cx": V("ax") + V("dx"), "cy": V("ay") + V("dy")}).drop("ax", "ay", "dx", "dy")
        asks = left.withColumns({"cx": cell("vx"), "cy": cell("vy")})
        d = F.pow(V("sx") - V("vx"), F.lit(2)) + F.pow((V("sy") - V("vy")) * aspect, F.lit(2))
        best = asks.join(held, [*TILE, "cx", "cy"], "inner" if last else "left")
        best = best.groupBy(*keys).agg(F.min(F.when(V("sx").isNotNull(), F.struct(d.alias("d"), "seed_ix"))).alias("best"))
        sure = F.lit(True) if last else F.coalesce(V("best.d") < (side * stretch) ** 2, F.lit(False))
        done = best.where(sure).select(*keys, V("best.seed_ix").alias("seed_ix"))
        found = done if found is None else found.unionByName(done)
        left = best.where(~sure).select(*keys)
    return found
