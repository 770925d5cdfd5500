"""Fills, strokes, disks and stamps as aliased pixels: a pixel is covered if its centre is.

Shapes are exploded to the pixel rows they meet, each row to the stretches between crossings, these to pixels: the work is
that of the pixels drawn. A feature covers a pixel once, however many of its parts do. ``paint`` lays features over each
other in their order (source over), with one shuffle by pixel. Paint properties are columns, so they may differ by feature.
Strokes and disks are drawn for opaque features first: what lies under their tops is neither drawn nor shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as colors
from ..functions.arith import clamp, to_byte
from .geometry import EXTENT, SHAPES, _segments, point, shape
from .grid import BANDS, PIXEL, TILE, Grid

V = F.col
ORDER = "feature_ix"
#: Opaque strokes of a tile that are drawn before all others; lines that cross a tile at random cover it with fewer.
FRONT = 512


def _paint_columns(fill: Column | str, opacity: Column | float) -> dict[str, Column]:
    """Straight shares of 1 in columns p_r, p_g, p_b, p_a; ``fill`` is a colour or a struct of shares r, g, b, a."""
    if isinstance(fill, str):
        r, g, b, a = (F.lit(c) for c in colors.parse(fill))
    else:
        r, g, b, a = (fill[c] for c in BANDS)
    return dict(zip(("p_r", "p_g", "p_b", "p_a"), (r, g, b, clamp(a * opacity, 0, 1))))


def _in_pixels(df: DataFrame, name: str, size: int, extent: int) -> Column:
    """Vertices of a shape in pixels."""
    k = size / extent
    ring = lambda r: F.transform(r, lambda p: point(p["x"] * k, p["y"] * k))
    deep = {"points": ring, "lines": lambda c: F.transform(c, ring), "polygons": lambda c: F.transform(c, lambda p: F.transform(p, ring))}
    return deep[name](shape(df, name))


def _rows_between(low: Column, high: Column, size: int) -> Column:
    """Rows (or columns) of pixels whose centres lie in [low, high)."""
    first = F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(high - 0.5) - 1, F.lit(size - 1)).cast("int")
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def filled(df: DataFrame, size: int, extent: int = EXTENT) -> DataFrame:
    """(other columns, px, py): pixels inside a feature's polygons, by even and odd crossings of each polygon's rings."""
    rest = [c for c in df.columns if c not in SHAPES]
    rows = df.select(*rest, F.posexplode(_in_pixels(df, "polygons", size, extent)).alias("__part", "__rings"))
    rows = rows.select(*rest, "__part", F.explode(F.flatten(F.transform("__rings", lambda r: _segments(r, True)))).alias("e"))
    low, high = F.least(V("e.a.y"), V("e.b.y")), F.greatest(V("e.a.y"), V("e.b.y"))
    rows = rows.withColumn("py", F.explode(_rows_between(low, high, size)))
    at = V("e.a.x") + (V("py") + 0.5 - V("e.a.y")) * F.try_divide(V("e.b.x") - V("e.a.x"), V("e.b.y") - V("e.a.y"))
    # The crossings of one polygon with one row of pixels.
    rows = rows.groupBy(*rest, "__part", "py").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    pairs = F.filter(F.transform("xs", lambda x, i: F.struct(i.alias("i"), x.alias("x0"), F.get("xs", i + 1).alias("x1"))), lambda q: (q["i"] % 2 == 0) & q["x1"].isNotNull())
    rows = rows.select(*rest, "py", F.explode(pairs).alias("q"))
    rows = rows.select(*rest, "py", F.explode(_rows_between(V("q.x0"), V("q.x1"), size)).alias("px"))
    return rows.select(*rest, "px", "py")


def _convex_rows(pieces: DataFrame, rest: list[str], size: int) -> DataFrame:
    """Pixels of convex pieces: three or four ``corners``, or a disc of radius ``r`` around (cx, cy) where there are none."""
    # Plain columns: functions on arrays would be worked out anew for each row of pixels.
    corner = lambda i: F.coalesce(F.get("corners", F.lit(i)), F.element_at("corners", -1))
    flat = pieces.select(*dict.fromkeys([*rest, "r", "cx", "cy"]), *[corner(i)[c].alias(f"__{c}{i}") for i in range(4) for c in "xy"])
    ys = [V(f"__y{i}") for i in range(4)]
    disc = V("__y0").isNull()
    low = F.when(disc, V("cy") - V("r")).otherwise(F.least(*ys))
    high = F.when(disc, V("cy") + V("r")).otherwise(F.greatest(*ys))
    rows = flat.withColumn("py", F.explode(_rows_between(low, high, size)))
    y = V("py") + 0.5
    half = F.sqrt(F.greatest(V("r") * V("r") - (y - V("cy")) * (y - V("cy")), F.lit(0.0)))

    def crossing(i: int) -> Column:
        j = (i + 1) % 4
        return F.when((ys[i] > y) != (ys[j] > y), V(f"__x{i}") + (y - ys[i]) * F.try_divide(V(f"__x{j}") - V(f"__x{i}"), ys[j] - ys[i]))

    hits = [crossing(i) for i in range(4)]
    rows = rows.select(*rest, "py", F.when(disc, V("cx") - half).otherwise(F.least(*hits)).alias("x0"), F.when(disc, V("cx") + half).otherwise(F.greatest(*hits)).alias("x1"))
    return rows.select(*rest, F.explode(_rows_between(V("x0"), V("x1"), size)).alias("px"), "py")


def stroked(df: DataFrame, size: int, width: Column | float, cap: str = "butt", join: str = "miter", miter_limit: float = 4.0, extent: int = EXTENT) -> DataFrame:
    """(other columns, px, py): pixels of lines ``width`` pixels wide, each once per feature.

    ``cap``: butt, round, square. ``join``: miter (bevelled where its tip is further out than ``miter_limit`` half widths),
    round, bevel.
    """
    return _stroked_parts(df, size, width, cap, join, miter_limit, extent).dropDuplicates([*TILE, ORDER, "px", "py"])


def _stroked_parts(df: DataFrame, size: int, width: Column | float, cap: str, join: str, miter_limit: float, extent: int) -> DataFrame:
    """The same, but a pixel as often as parts of its feature cover it."""
    rest = [c for c in df.columns if c not in SHAPES]
    w = width if isinstance(width, Column) else F.lit(float(width))
    rows = df.withColumn("__h", w / 2).where("__h > 0")
    rows = rows.select(*rest, "__h", F.explode(_in_pixels(df, "lines", size, extent)).alias("__line"))
    # Vertices that repeat have no direction.
    once = F.filter("__line", lambda p, i: (i == 0) | (p != F.get("__line", i - 1)))
    rows = rows.withColumn("__line", once).where(F.size("__line") >= 2)
    h = V("__h")

    def directed(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        length = F.sqrt(dx * dx + dy * dy)
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), (dx / length).alias("ux"), (dy / length).alias("uy"))

    rows = rows.withColumn("__s", F.transform(_segments(V("__line"), False), directed))
    n = F.size("__s")
    square = 1.0 if cap == "square" else 0.0

    def strip(s: Column, i: Column) -> Column:
        before, after = F.when(i == 0, h * square).otherwise(0.0), F.when(i == n - 1, h * square).otherwise(0.0)
        ax, ay = s["a"]["x"] - s["ux"] * before, s["a"]["y"] - s["uy"] * before
        bx, by = s["b"]["x"] + s["ux"] * after, s["b"]["y"] + s["uy"] * after
        nx, ny = -s["uy"] * h, s["ux"] * h
        return F.array(point(ax - nx, ay - ny), point(bx - nx, by - ny), point(bx + nx, by + ny), point(ax + nx, ay + ny))

    def corner(s: Column, i: Column) -> Column:
        """What fills the outer side between a segment and the next; null where nothing does."""
        t = F.get("__s", i + 1)
        turn = s["ux"] * t["uy"] - s["uy"] * t["ux"]
        side = F.when(turn > 0, -1.0).otherwise(1.0) * h
        p = s["b"]
        ax, ay = p["x"] - s["uy"] * side, p["y"] + s["ux"] * side
        bx, by = p["x"] - t["uy"] * side, p["y"] + t["ux"] * side
        # The middle of both normals reaches out by the cosine of half the turn.
        mx, my = -(s["uy"] + t["uy"]) / 2, (s["ux"] + t["ux"]) / 2
        cos2 = mx * mx + my * my
        tip = point(p["x"] + F.try_divide(mx * side, cos2), p["y"] + F.try_divide(my * side, cos2))
        flat, sharp = F.array(p, point(ax, ay), point(bx, by)), F.array(p, point(ax, ay), tip, point(bx, by))
        out = F.when(cos2 * miter_limit**2 >= 1, sharp).otherwise(flat) if join == "miter" else flat
        return F.when(t.isNotNull() & (F.abs(turn) > 1e-12), out)

    polygon = lambda c: F.struct(c.alias("corners"), F.lit(None).cast("double").alias("cx"), F.lit(None).cast("double").alias("cy"))
    disc = lambda p: F.struct(F.lit(None).cast(SHAPES["points"]).alias("corners"), p["x"].alias("cx"), p["y"].alias("cy"))
    pieces = [F.transform(F.transform("__s", strip), polygon)]
    if join == "round":
        inner = F.slice("__line", 2, F.greatest(F.size("__line") - 2, F.lit(0)))
        pieces.append(F.transform(inner, disc))
    else:
        pieces.append(F.transform(F.filter(F.transform("__s", corner), lambda c: c.isNotNull()), polygon))
    if cap == "round":
        pieces.append(F.transform(F.array(V("__line")[0], F.element_at("__line", -1)), disc))
    rows = rows.select(*rest, h.alias("r"), F.explode(F.concat(*pieces)).alias("q")).select(*rest, "r", "q.*")
    return _convex_rows(rows, rest, size)


def disks(df: DataFrame, size: int, radius: Column | float, stroke_width: Column | float = 0.0, extent: int = EXTENT) -> DataFrame:
    """(other columns, px, py, rim): pixels of disks around points, and of the rims of ``stroke_width`` around these."""
    # Of a feature's several disks the inside wins over a rim.
    rest = [c for c in df.columns if c not in SHAPES]
    return _disk_parts(df, size, radius, stroke_width, extent).groupBy(*rest, "px", "py").agg(F.min("rim").alias("rim"))


def _disk_parts(df: DataFrame, size: int, radius: Column | float, stroke_width: Column | float, extent: int) -> DataFrame:
    """The same, but a pixel as often as disks of its feature cover it."""
    rest = [c for c in df.columns if c not in SHAPES]
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    s = stroke_width if isinstance(stroke_width, Column) else F.lit(float(stroke_width))
    rows = df.withColumns({"__r": F.greatest(r, F.lit(0.0)), "__s": F.greatest(s, F.lit(0.0))})
    rows = rows.select(*rest, "__r", (V("__r") + V("__s")).alias("r"), F.explode(_in_pixels(df, "points", size, extent)).alias("p")).where("r > 0")
    pieces = rows.select(*rest, "__r", "r", F.lit(None).cast(SHAPES["points"]).alias("corners"), V("p.x").alias("cx"), V("p.y").alias("cy"))
    out = _convex_rows(pieces, [*rest, "__r", "cx", "cy"], size)
    d2 = F.pow(V("px") + 0.5 - V("cx"), F.lit(2)) + F.pow(V("py") + 0.5 - V("cy"), F.lit(2))
    return out.select(*rest, "px", "py", (d2 >= V("__r") * V("__r")).alias("rim"))


def paint(rows: DataFrame, size: int, order: list[str] | None = None) -> Grid:
    """Pixels (p_r, p_g, p_b, p_a: straight shares) laid over each other by ``order``, rounded once at the end.

    What lies under an opaque pixel counts nothing. The share that shines through is a product, summed as logarithms from
    the top down while a pixel's rows stream by: no pixel's rows are ever gathered. Each pixel's topmost opaque row is
    found first, in one pass that shuffles a row a pixel and task; what lies under it is left out before rows are sorted.
    """
    keys = order or [ORDER]
    return _laid(_above_opaque(rows, keys), size, keys)


def _by_pixel(rows: DataFrame) -> DataFrame:
    """Dealt once for all that is done by pixel, also where z is one number."""
    return rows.repartition(*PIXEL[1:])


def _laid(rows: DataFrame, size: int, keys: list[str]) -> Grid:
    top = Window.partitionBy(*PIXEL).orderBy(*[F.desc(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where("p_a > 0")
    opaque = V("p_a") >= 1
    rows = rows.withColumn("under", F.coalesce(F.sum(F.when(opaque, 1).otherwise(0)).over(top), F.lit(0)))
    rows = rows.withColumn("through", F.coalesce(F.sum(F.when(opaque, 0.0).otherwise(F.log(1 - V("p_a")))).over(top), F.lit(0.0)))
    share = V("p_a") * F.exp("through")
    out = rows.where("under = 0").groupBy(*PIXEL)
    sums = out.agg(*[F.sum(V(f"p_{c}") * share).alias(c) for c in "rgb"], F.sum(share).alias("a"))
    # A hair above or below a half from rounded sums does not decide a byte.
    return Grid(sums.select(*PIXEL, *[to_byte(F.round(V(c), 12)).alias(c) for c in BANDS]), size, size)


def _above_opaque(rows: DataFrame, keys: list[str], most: int = 1 << 20) -> DataFrame:
    """Rows at or above the topmost opaque row of their pixel; tops are sent to all tasks up to ``most`` pixels."""
    tops = _tops(rows.where("p_a >= 1"), keys)
    return _not_below(rows, F.broadcast(tops) if tops.count() <= most else tops, keys)


def _rank(keys: list[str]) -> Column:
    """What rows are laid by. A struct, unlike a plain column, is compared in sorts of all rows."""
    return V(keys[0]) if len(keys) == 1 else F.struct(*keys)


def _tops(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*PIXEL).agg(F.max(_rank(keys)).alias("top")).checkpoint()


def _not_below(rows: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tops, list(PIXEL), "left").where(V("top").isNull() | (_rank(keys) >= V("top"))).drop("top")


def _in_sight(df: DataFrame, size: int, opaque: Column, drawn, sure: Column, front: int = 0, most: int = 1 << 20) -> DataFrame:
    """Rows of ``drawn(features)`` at or above the topmost opaque row of their pixel, found from features that are ``opaque``.

    ``sure``: rows that are opaque whatever else of their feature lies at their pixel. Rows of a feature may still repeat.
    Where a tile has ``front`` opaque features or more, these are drawn first: if they cover it, its other tops are not asked
    for. Tops are sent to all tasks up to ``most`` pixels; nothing that is hidden is shuffled.
    """
    tops_of = lambda f: _tops(drawn(f.where(opaque)).where(sure), [ORDER])
    known = False
    if front:
        foremost = Window.partitionBy(*TILE).orderBy(F.desc("nth"))
        ends = df.where(opaque).select(*TILE, V(ORDER).alias("nth")).withColumn("n", F.row_number().over(foremost))
        ends = ends.where(V("n") <= front).where(V("n").isin(1, front)).checkpoint()
        deep = ends.where(V("n") == front).drop("n")
        if 0 < deep.count() <= most:
            tops = tops_of(df.join(F.broadcast(deep), list(TILE)).where(V(ORDER) >= V("nth")).drop("nth"))
            floors = _floors(tops, size)
            df, known = _above(df, floors, most), floors.count() == ends.where("n = 1").count()
    if not known:
        tops = tops_of(df)
        df = _above(df, _floors(tops, size), most)
    return _not_below(drawn(df), F.broadcast(tops) if tops.count() <= most else tops, [ORDER])


def _floors(tops: DataFrame, size: int) -> DataFrame:
    """The lowest of a tile's tops, where these cover it."""
    return tops.groupBy(*TILE).agg(F.min("top").alias("floor"), F.count("*").alias("n")).where(V("n") == size * size).drop("n").checkpoint()


def _above(df: DataFrame, floors: DataFrame, most: int) -> DataFrame:
    """Features of which something may be seen over the floors of their tiles."""
    if not 0 < floors.count() <= most:
        return df
    return df.join(F.broadcast(floors), list(TILE), "left").where(V("floor").isNull() | (V(ORDER) >= V("floor"))).drop("floor")


def fill_solid(df: DataFrame, size: int, fill: Column | str, opacity: Column | float = 1.0, edge: Column | str | None = None, edge_width: Column | float = 1.0, edge_opacity: Column | float = 1.0, extent: int = EXTENT) -> Grid:
    """Polygons painted in their order; with ``edge``, each one's outline over its fill."""
    rows = filled(df.withColumns(_paint_columns(fill, opacity)), size, extent).withColumn("__layer", F.lit(0))
    if edge is not None:
        from .geometry import boundary

        outline = boundary(df.drop("lines", "points")).withColumns(_paint_columns(edge, edge_opacity))
        rows = rows.unionByName(stroked(outline, size, edge_width, "butt", "miter", extent=extent).withColumn("__layer", F.lit(1)))
    columns = [*PIXEL, ORDER, "__layer", "p_r", "p_g", "p_b", "p_a"]
    return paint(rows.select(*columns).dropDuplicates([*PIXEL, ORDER, "__layer"]), size, [ORDER, "__layer"])


def stroke(df: DataFrame, size: int, color: Column | str, width: Column | float = 1.0, opacity: Column | float = 1.0, cap: str = "butt", join: str = "miter", miter_limit: float = 4.0, dash_px: tuple[float, float] | None = None, phase_px: float = 0.0, extent: int = EXTENT) -> Grid:
    """Lines painted in their order, dashed if asked."""
    ink = _paint_columns(color, opacity)
    df = df.withColumns({**ink, "__w": width if isinstance(width, Column) else F.lit(float(width))})
    df = df.select(*TILE, ORDER, shape(df, "lines").alias("lines"), *ink, "__w").where("p_a > 0")

    def drawn(f: DataFrame) -> DataFrame:
        if dash_px:
            from .geometry import dash

            k = extent / size
            f = dash(f, dash_px[0] * k, dash_px[1] * k, phase_px * k)
        return _stroked_parts(f, size, V("__w"), cap, join, miter_limit, extent)

    rows = _by_pixel(_in_sight(df, size, V("p_a") >= 1, drawn, F.lit(True), FRONT))
    return _laid(rows.dropDuplicates([*PIXEL, ORDER]), size, [ORDER])


def circles(df: DataFrame, size: int, radius: Column | float, color: Column | str, opacity: Column | float = 1.0, stroke_width: Column | float = 0.0, stroke_color: Column | str = "#000000", stroke_opacity: Column | float = 1.0, extent: int = EXTENT) -> Grid:
    """Disks at points painted in their order, with rims."""
    inner, rim = _paint_columns(color, opacity), _paint_columns(stroke_color, stroke_opacity)
    both = {**inner, **{f"{n}_rim": c for n, c in rim.items()}}
    as_column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    df = df.withColumns({**both, "__radius": as_column(radius), "__width": as_column(stroke_width)})
    df = df.select(*TILE, ORDER, shape(df, "points").alias("points"), *both, "__radius", "__width", (F.size(shape(df, "points")) == 1).alias("__one"))
    drawn = lambda f: _disk_parts(f, size, V("__radius"), V("__width"), extent).drop("__radius", "__width")
    # Another disk of the feature may lie over a rim with its inside.
    full, edge = V("p_a") >= 1, V("p_a_rim") >= 1
    sure = F.when(V("rim"), edge & (full | V("__one"))).otherwise(full)
    rows = _in_sight(df, size, full | edge, drawn, sure).drop("__one")
    rows = _by_pixel(rows).groupBy(*[c for c in rows.columns if c != "rim"]).agg(F.min("rim").alias("rim"))
    return _laid(rows.select(*PIXEL, ORDER, *[F.when(V("rim"), V(f"{n}_rim")).otherwise(V(n)).alias(n) for n in inner]), size, [ORDER])


# Placements


def stamp_places(df: DataFrame, size: int, rotation_deg: Column | float = 0.0, scale: Column | float = 1.0, jitter_px: float = 0.0, rotation_jitter_deg: float = 0.0, scale_jitter: float = 0.0, seed: int = 0, extent: int = EXTENT) -> DataFrame:
    """(other columns, i, cx, cy, angle_deg, scale): where a picture's middle goes for each point, in pixels.

    Jitter is drawn from the point's place in the world, so that tiles agree on it.
    """
    from .raster import cell_hash

    rest = [c for c in df.columns if c not in SHAPES]
    as_column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    rows = df.withColumns({"__t": as_column(rotation_deg), "__k": as_column(scale)})
    rows = rows.select(*rest, "__t", "__k", F.posexplode(shape(df, "points")).alias("i", "p"))
    world = lambda t, k: F.pmod(V(t).cast("long") * extent + V(f"p.{k}").cast("long"), F.lit(2147483647))
    draw = lambda s: cell_hash(world("x", "x"), world("y", "y"), salt=seed * 8 + s) / 2147483647 * 2 - 1
    k = size / extent
    places = {"cx": V("p.x") * k + draw(1) * jitter_px, "cy": V("p.y") * k + draw(2) * jitter_px}
    turned = {"angle_deg": V("__t") + draw(3) * rotation_jitter_deg, "scale": V("__k") * (1 + draw(4) * scale_jitter)}
    return rows.withColumns(places | turned).select(*rest, "i", *places, *turned).where("scale > 0")


def line_stamp_places(df: DataFrame, size: int, spacing_px: float, extent: int = EXTENT) -> DataFrame:
    """(other columns, part, n, cx, cy, angle_deg): places every ``spacing_px`` along lines, the first half a step in.

    The rest of a step carries over vertices; the angle is that of the segment. Segments shorter than a millionth of a
    pixel are none.
    """
    from .geometry import _measured

    rest = [c for c in df.columns if c not in SHAPES]
    rows = df.select(*rest, F.posexplode(_in_pixels(df, "lines", size, extent)).alias("part", "line"))
    rows = rows.select(*rest, "part", F.explode(F.filter(_measured(V("line")), lambda s: s["l"] >= 1e-6)).alias("s"))
    number = lambda at: F.floor(at / spacing_px - 0.5)
    first = F.when(V("s.at") == 0, F.lit(0)).otherwise(number(V("s.at")) + 1)
    last = number(V("s.at") + V("s.l"))
    rows = rows.withColumns({"k0": first, "k1": last}).where("k1 >= k0").withColumn("n", F.explode(F.sequence("k0", "k1")))
    t = ((V("n") + 0.5) * spacing_px - V("s.at")) / V("s.l")
    dx, dy = V("s.b.x") - V("s.a.x"), V("s.b.y") - V("s.a.y")
    return rows.select(*rest, "part", "n", (V("s.a.x") + dx * t).alias("cx"), (V("s.a.y") + dy * t).alias("cy"), F.degrees(F.atan2(dy, dx)).alias("angle_deg"))


def fill_dab_places(df: DataFrame, size: int, spacing_px: float, radius_px: float, position_jitter: float = 0.5, size_jitter: float = 0.0, opacity_jitter: float = 0.0, seed: int = 0, extent: int = EXTENT) -> DataFrame:
    """(other columns, i, j, cx, cy, radius, opacity): a dab for each cell of a world lattice whose middle lies in a polygon.

    Place, size and opacity vary by the cell alone, so that tiles agree on them.
    """
    from .geometry import _box_of, contains
    from .raster import cell_hash

    rest = [c for c in df.columns if c not in SHAPES]
    step = max(spacing_px, 1.0) * extent / size
    b = _box_of(df)
    rows = df.withColumns(b).where("b0 IS NOT NULL")
    cells = lambda t, lo, hi: F.sequence(F.floor((V(lo) + V(t) * extent) / step), F.floor((V(hi) + V(t) * extent) / step))
    rows = rows.withColumn("j", F.explode(cells("y", "b2", "b3"))).withColumn("i", F.explode(cells("x", "b0", "b1")))
    cell = lambda c: F.pmod(V(c), F.lit(2147483647))
    draw = lambda s: cell_hash(cell("i"), cell("j"), salt=seed * 8 + s) / 2147483647 * 2 - 1
    at = lambda c, t, s: (V(c) + 0.5 + draw(s) / 2 * position_jitter) * step - V(t) * extent
    rows = rows.withColumns({"vx": at("i", "x", 1), "vy": at("j", "y", 2)})
    rows = rows.where(contains(rows, V("vx"), V("vy")))
    k = size / extent
    vary = lambda base, share, s: base * (1 + draw(s) * share)
    return rows.select(*rest, "i", "j", (V("vx") * k).alias("cx"), (V("vy") * k).alias("cy"), vary(F.lit(float(radius_px)), size_jitter, 3).alias("radius"), clamp(vary(F.lit(1.0), opacity_jitter, 4), 0, 1).alias("opacity"))


def draw_stamps(places: DataFrame, sprite: Grid, size: int, opacity: Column | float = 1.0, most: int = 1 << 20) -> Grid:
    """A picture of one tile drawn at each place (cx, cy in pixels, angle_deg, scale), in order, by its nearest pixels.

    Every place is exploded to the pixels that its turned picture may reach; the picture is sent to all tasks if it has at
    most ``most`` pixels, and joined by a shuffle otherwise.
    """
    o = opacity if isinstance(opacity, Column) else F.lit(float(opacity))
    has = places.columns
    rows = places.withColumns({"angle_deg": V("angle_deg") if "angle_deg" in has else F.lit(0.0), "scale": V("scale") if "scale" in has else F.lit(1.0), "__o": o})
    keys = [c for c in (ORDER, "part", "n", "i", "j") if c in has]
    reach = V("scale") * (math.hypot(sprite.width, sprite.height) / 2)
    rows = rows.withColumn("py", F.explode(_rows_between(V("cy") - reach, V("cy") + reach, size)))
    rows = rows.withColumn("px", F.explode(_rows_between(V("cx") - reach, V("cx") + reach, size)))
    c, s = F.cos(F.radians("angle_deg")), F.sin(F.radians("angle_deg"))
    dx, dy = V("px") + 0.5 - V("cx"), V("py") + 0.5 - V("cy")
    u = F.floor((dx * c + dy * s) / V("scale") + sprite.width / 2).cast("int")
    v = F.floor((dy * c - dx * s) / V("scale") + sprite.height / 2).cast("int")
    rows = rows.withColumns({"qx": u, "qy": v})
    picture = sprite.df.where("a > 0").select(V("px").alias("qx"), V("py").alias("qy"), *[(V(b) / V("a")).alias(f"p_{b}") for b in "rgb"], (V("a") / 255).alias("p_a"))
    few = picture.limit(most + 1).count() <= most
    rows = rows.join(F.broadcast(picture) if few else picture, ["qx", "qy"]).withColumn("p_a", V("p_a") * V("__o"))
    return paint(rows.select(*PIXEL, *keys, "p_r", "p_g", "p_b", "p_a"), size, keys)
