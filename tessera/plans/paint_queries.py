"""Queries of fills, strokes, disks, stamps, set operations and styles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import coverage as O
from ..operators import geometry, kernels, overlay
from ..operators.grid import Grid
from ..sources.lift import lifted, pixels
from . import translate
from .geometry_queries import FK, LV, MEASURED, SEG, _SEGTO, lines, points, rects
from .registry import KEY, query, sql_byte, sql_draw

SIZE = 64
#: Paint of every feature, as shares: red by its number, half opaque or wholly where the number is a multiple of five.
RED, BLUE, ALPHA = "(feature_ix % 4) / CAST(4 AS DOUBLE)", "CAST(0.5 AS DOUBLE)", "CASE WHEN feature_ix % 5 = 0 THEN 1.0 ELSE 0.5 END"


def _ink():
    return F.struct(F.expr(RED).alias("r"), F.lit(0.25).alias("g"), F.lit(0.5).alias("b"), F.expr(f"CAST({ALPHA} AS DOUBLE)").alias("a"))


def painted(cover: str, order: str = "feature_ix") -> str:
    """SQL that lays the rows of ``cover`` (pixels and feature_ix, r, g, b, a in shares) over each other."""
    top = f"OVER (PARTITION BY {KEY} ORDER BY {order} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{cover}, lit AS (SELECT *, coalesce(sum(CASE WHEN a >= 1 THEN 1 ELSE 0 END) {top}, 0) AS under, coalesce(sum(CASE WHEN a >= 1 THEN 0 ELSE ln(1 - a) END) {top}, 0) AS through FROM cover),
shade AS (SELECT {KEY}, {', '.join(f"sum({c} * a * exp(through)) AS {c}" for c in 'rgb')}, sum(a * exp(through)) AS a FROM lit WHERE under = 0 GROUP BY {KEY})
SELECT {KEY}, {', '.join(f"{sql_byte(f'round({c}, 12)')} AS {c}" for c in 'rgba')} FROM shade"""


INK = f"{RED} AS r, CAST(0.25 AS DOUBLE) AS g, {BLUE} AS b, CAST({ALPHA} AS DOUBLE) AS a"
_RANGE = lambda lo, hi: f"unnest(range(greatest(CAST(ceil({lo} - 0.5) AS BIGINT), 0), least(CAST(ceil({hi} - 0.5) AS BIGINT), {SIZE})))"

query("fill_solid", painted(f"""WITH k AS (SELECT {FK}, y0, y1, CAST({_RANGE('x0 / 64.0', 'x1 / 64.0')} AS INT) AS px FROM lift_rects),
cover AS (SELECT {FK}, px, CAST({_RANGE('y0 / 64.0', 'y1 / 64.0')} AS INT) AS py, {INK} FROM k)"""), "lift_rects")(
    lambda spark, d: O.fill_solid(rects(spark, d), SIZE, _ink()).df)

_NEAR = "sqrt(pow(px + 0.5 - (ax + (bx - ax) * t), 2) + pow(py + 0.5 - (ay + (by_ - ay) * t), 2))"
query("stroke", painted(f"""WITH {SEG}, f AS (SELECT {FK}, ax / 64.0 AS ax, ay / 64.0 AS ay, bx / 64.0 AS bx, by_ / 64.0 AS by_ FROM g WHERE l > 0),
c AS (SELECT *, {_RANGE('least(ax, bx) - 0.735', 'greatest(ax, bx) + 0.735')} AS px FROM f), p AS (SELECT *, {_RANGE('least(ay, by_) - 0.735', 'greatest(ay, by_) + 0.735')} AS py FROM c),
n AS (SELECT *, least(greatest(((px + 0.5 - ax) * (bx - ax) + (py + 0.5 - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)), 0), 1) AS t FROM p),
cover AS (SELECT DISTINCT {FK}, CAST(px AS INT) AS px, CAST(py AS INT) AS py, {INK} FROM n WHERE {_NEAR} < 0.735)"""), LV)(
    lambda spark, d: O.stroke(lines(spark, d), SIZE, _ink(), 1.47, cap="round", join="round").df)
query("stroke_mitred")(lambda spark, d: O.stroke(lines(spark, d), SIZE, _ink(), 3.0, cap="square", join="miter", dash_px=(6.0, 3.0)).df)

_DISK = "pow(px + 0.5 - vx / 64.0, 2) + pow(py + 0.5 - vy / 64.0, 2)"
query("circles", painted(f"""WITH p AS {_SEGTO}, c AS (SELECT *, {_RANGE('vx / 64.0 - 3.07', 'vx / 64.0 + 3.07')} AS px FROM p), d AS (SELECT *, {_RANGE('vy / 64.0 - 3.07', 'vy / 64.0 + 3.07')} AS py FROM c),
i AS (SELECT *, {INK} FROM d WHERE {_DISK} < 9.4249),
cover AS (SELECT {FK}, CAST(px AS INT) AS px, CAST(py AS INT) AS py, {', '.join(f"CASE WHEN {_DISK} >= 4.1209 THEN {v} ELSE {c} END AS {c}" for c, v in (('r', '1.0'), ('g', '1.0'), ('b', '1.0'), ('a', '0.75')))} FROM i)"""), "lift_tiled")(
    lambda spark, d: O.circles(_dots(spark, d), SIZE, 2.03, _ink(), stroke_width=1.04, stroke_color="#ffffff", stroke_opacity=0.75).df)


def _dots(spark, d):
    return points(spark, d).select("z", "x", "y", "feature_ix", "kind", "value", F.array(geometry.point(F.col("vx"), F.col("vy"))).alias("points"))


def _micro(df, *columns):
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[F.round(F.col(c) * 1000).cast("long").alias(c) for c in columns])


M3 = lambda e, n: f"CAST(round(({e}) * 1000) AS BIGINT) AS {n}"
query("line_stamp_places", f"""WITH {MEASURED}, k AS (SELECT *, unnest(range(CASE WHEN at_ = 0 THEN 0 ELSE CAST(floor(at_ / 64 / 20 - 0.5) AS BIGINT) + 1 END, CAST(floor((at_ + l) / 64 / 20 - 0.5) AS BIGINT) + 1)) AS n FROM m WHERE l > 0)
SELECT {FK}, 0 AS part, n, {M3('(ax + (bx - ax) * ((n + 0.5) * 20 * 64 - at_) / l) / 64', 'cx')}, {M3('(ay + (by_ - ay) * ((n + 0.5) * 20 * 64 - at_) / l) / 64', 'cy')}, {M3('degrees(atan2(by_ - ay, bx - ax))', 'angle_deg')} FROM k""", LV)(
    lambda spark, d: _micro(O.line_stamp_places(lines(spark, d), SIZE, 20.0), "cx", "cy", "angle_deg"))
_J = lambda s: f"({sql_draw('x * 4096 + vx', 'y * 4096 + vy', salt=24 + s)} * 2 - 1)"
query("stamp_places", f"""WITH p AS {_SEGTO} SELECT {FK}, 0 AS i, {M3(f'vx / 64.0 + {_J(1)} * 2', 'cx')}, {M3(f'vy / 64.0 + {_J(2)} * 2', 'cy')}, {M3(f'30 + {_J(3)} * 15', 'angle_deg')}, {M3(f'1.5 * (1 + {_J(4)} * 0.25)', 'scale')} FROM p""", "lift_tiled")(
    lambda spark, d: _micro(O.stamp_places(_dots(spark, d).drop("kind", "value"), SIZE, 30.0, 1.5, 2.0, 15.0, 0.25, seed=3), "cx", "cy", "angle_deg", "scale"))
_B = lambda s: f"({sql_draw('i', 'j', salt=16 + s)} * 2 - 1)"
query("fill_dab_places", f"""WITH j AS (SELECT *, unnest(range(CAST(floor((y0 + y * 4096) / 96.0) AS BIGINT), CAST(floor((y1 + y * 4096) / 96.0) AS BIGINT) + 1)) AS j FROM lift_rects),
i AS (SELECT *, unnest(range(CAST(floor((x0 + x * 4096) / 96.0) AS BIGINT), CAST(floor((x1 + x * 4096) / 96.0) AS BIGINT) + 1)) AS i FROM j),
p AS (SELECT *, (i + 0.5 + {_B(1)} / 2 * 0.5) * 96 - x * 4096 AS vx, (j + 0.5 + {_B(2)} / 2 * 0.5) * 96 - y * 4096 AS vy FROM i)
SELECT {FK}, i, j, {M3('vx / 64', 'cx')}, {M3('vy / 64', 'cy')}, {M3(f'2 * (1 + {_B(3)} * 0.5)', 'radius')}, {M3(f'least(greatest(1 + {_B(4)} * 0.5, 0), 1)', 'opacity')} FROM p WHERE vx >= x0 AND vx < x1 AND vy >= y0 AND vy < y1""", "lift_rects")(
    lambda spark, d: _micro(O.fill_dab_places(rects(spark, d).drop("kind", "value"), SIZE, 1.5, 2.0, 0.5, 0.5, 0.5, seed=2), "cx", "cy", "radius", "opacity"))


def _sprite(spark, d) -> Grid:
    p = pixels(spark, d)
    return Grid(p.df.where("x = 0 AND y = 0 AND px < 8 AND py < 8").select("px", "py", "r", "g", "b", "a"), 8, 8)


query("stamp", painted(f"""WITH p AS {_SEGTO}, c AS (SELECT *, {_RANGE(f'vx / 64.0 - {math.hypot(8, 8) / 2!r}', f'vx / 64.0 + {math.hypot(8, 8) / 2!r}')} AS px FROM p),
q AS (SELECT *, {_RANGE(f'vy / 64.0 - {math.hypot(8, 8) / 2!r}', f'vy / 64.0 + {math.hypot(8, 8) / 2!r}')} AS py FROM c),
u AS (SELECT {FK}, CAST(q.px AS INT) AS px, CAST(q.py AS INT) AS py, CAST(floor(q.px + 0.5 - vx / 64.0 + 4) AS INT) AS qx, CAST(floor(q.py + 0.5 - vy / 64.0 + 4) AS INT) AS qy FROM q),
cover AS (SELECT u.*, s.r / CAST(s.a AS DOUBLE) AS r, s.g / CAST(s.a AS DOUBLE) AS g, s.b / CAST(s.a AS DOUBLE) AS b, s.a / CAST(255 AS DOUBLE) * 0.5 AS a FROM u JOIN lift_pixels AS s ON s.x = 0 AND s.y = 0 AND s.px = qx AND s.py = qy AND s.px < 8 AND s.py < 8 AND s.a > 0)"""), "lift_tiled", "lift_pixels")(
    lambda spark, d: O.draw_stamps(O.stamp_places(_dots(spark, d), SIZE), _sprite(spark, d), SIZE, 0.5).df)
query("line_stamp")(lambda spark, d: O.draw_stamps(O.line_stamp_places(lines(spark, d), SIZE, 8.0), _sprite(spark, d), SIZE).df)


def _box(spark, d):
    """A second set of polygons: one square in each tile."""
    tiles = rects(spark, d).select("z", "x", "y").distinct()
    return tiles.select("z", "x", "y", F.array(F.array(geometry.rectangle(1000, 1000, 3000, 3000))).alias("polygons"))


for _mode in ("union", "intersection", "difference", "xor"):
    query(f"feature_boolean_{_mode}")(lambda spark, d, m=_mode: geometry.vertices(overlay.feature_boolean(rects(spark, d), _box(spark, d), m, cells=4), "polygons"))
query("dissolve")(lambda spark, d: geometry.vertices(overlay.dissolve(rects(spark, d), "kind", cells=4), "polygons"))
query("stitch_union")(lambda spark, d: geometry.vertices(overlay.stitch(rects(spark, d).repartition(8), "kind", cells=2), "polygons"))
query("buffer_lines")(lambda spark, d: geometry.vertices(overlay.buffer(lines(spark, d).withColumn("lines", F.slice(F.transform("lines", lambda r: F.slice(r, 1, 5)), 1, 1)), 12.0, "round"), "polygons"))
query("buffer_polygons", f"""SELECT {FK}, CAST(CASE WHEN i IN (0, 3) THEN x0 - 10 ELSE x1 + 10 END AS BIGINT) AS vx, CAST(CASE WHEN i IN (0, 1) THEN y0 - 10 ELSE y1 + 10 END AS BIGINT) AS vy FROM lift_rects, (VALUES (0), (1), (2), (3)) AS k(i)""", "lift_rects")(
    lambda spark, d: _corners(overlay.buffer(rects(spark, d), 10.0)))
query("buffer_shrunk", f"""SELECT {FK}, CAST(CASE WHEN i IN (0, 3) THEN x0 + 9 ELSE x1 - 9 END AS BIGINT) AS vx, CAST(CASE WHEN i IN (0, 1) THEN y0 + 9 ELSE y1 - 9 END AS BIGINT) AS vy FROM lift_rects, (VALUES (0), (1), (2), (3)) AS k(i) WHERE x1 - x0 > 18 AND y1 - y0 > 18""", "lift_rects")(
    lambda spark, d: _corners(overlay.buffer(rects(spark, d), -9.0)))
query("polylabel")(lambda spark, d: geometry.vertices(kernels.polylabel(rects(spark, d)), "points"))
query("medial_axis")(lambda spark, d: geometry.vertices(kernels.medial_axis(rects(spark, d), 32.0), "lines"))
query("voronoi_fracture")(lambda spark, d: geometry.vertices(kernels.voronoi_fracture(_seeded(spark, d)), "polygons"))


def _corners(df):
    return geometry.vertices(df, "polygons").select("z", "x", "y", "feature_ix", F.col("vx").cast("long").alias("vx"), F.col("vy").cast("long").alias("vy"))


def _seeded(spark, d):
    """Rectangles with five seeds each."""
    r = rects(spark, d)
    p = F.col("polygons")[0][0]
    w, h = p[2]["x"] - p[0]["x"], p[2]["y"] - p[0]["y"]
    seeds = F.array(*[geometry.snapped(p[0]["x"] + w * a, p[0]["y"] + h * b) for a, b in ((0.1, 0.2), (0.8, 0.3), (0.5, 0.5), (0.2, 0.9), (0.9, 0.8))])
    return r.withColumn("seeds", seeds)


STYLE = {
    "layers": [
        {"id": "ground", "type": "background", "paint": {"background-color": "#203040"}},
        {"id": "blocks", "type": "fill", "source": "map", "source-layer": "blocks", "filter": ["!=", "kind", "5-LOW"], "paint": {"fill-color": ["match", ["get", "kind"], "1-URGENT", "#ff0000", "#00ff00"], "fill-opacity": 0.5}},
        {"id": "roads", "type": "line", "source": "map", "source-layer": "roads", "minzoom": 2, "layout": {"line-cap": "round", "line-join": "round"}, "paint": {"line-color": "#ffffff", "line-width": {"stops": [[0, 4], [4, 12]]}}},
        {"id": "late", "type": "line", "source": "map", "source-layer": "roads", "minzoom": 3, "paint": {"line-color": "#000000"}},
    ]
}


def _context(spark, d):
    sources = {"map.blocks": rects(spark, d), "map.roads": lines(spark, d)}
    return translate.Context(sources, rects(spark, d).select("z", "x", "y").distinct(), SIZE)


query("style_blocks", painted(f"""WITH k AS (SELECT {FK}, kind, y0, y1, CAST({_RANGE('x0 / 64.0', 'x1 / 64.0')} AS INT) AS px FROM lift_rects WHERE kind <> '5-LOW'),
cover AS (SELECT {FK}, px, CAST({_RANGE('y0 / 64.0', 'y1 / 64.0')} AS INT) AS py, CASE WHEN kind = '1-URGENT' THEN 1.0 ELSE 0.0 END AS r, CASE WHEN kind = '1-URGENT' THEN 0.0 ELSE 1.0 END AS g, 0.0 AS b, CAST(0.5 AS DOUBLE) AS a FROM k)"""), "lift_rects")(
    lambda spark, d: translate.translate(STYLE, _context(spark, d))["blocks"].df)
query("style_render")(lambda spark, d: translate.render(STYLE, _context(spark, d)).df)
