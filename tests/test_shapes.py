"""Set operations, buffers, cells and coverage against brute force over places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.expressions import compile_color, compile_expression, compile_filter, switch
from tessera.operators import clipping, coverage, geometry, kernels, overlay
from tessera.plans import translate


def inside(polygons, x, y):
    return overlay._winding(overlay._edges(polygons, False), x, y) % 2 == 1


def far_from_edges(polygons, x, y, least=1.5):
    e = overlay._edges(polygons, False)
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    p = np.column_stack([x, y])[:, None, :] - a
    t = np.clip((p * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-9), 0, 1)
    return (np.hypot(*np.moveaxis(p - d * t[..., None], -1, 0)) > least).all(1)


def test_overlay_of_random_polygons():
    rng = np.random.default_rng(1)
    for _ in range(25):
        a, b = ([[rng.integers(0, 200, (rng.integers(3, 8), 2)).astype(float)] for _ in range(rng.integers(1, 4))] for _ in range(2))
        x, y = rng.random((2, 400)) * 200
        clear = far_from_edges(a + b, x, y)
        x, y = x[clear], y[clear]
        for mode, rule in overlay.RULES.items():
            found = overlay.overlay(a, b, rule)
            assert (inside(found, x, y) == rule(inside(a, x, y), inside(b, x, y))).all(), mode


def test_overlay_of_shared_edges():
    square = lambda x, y: [np.array([(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10)], float)]
    (one,) = overlay.overlay([square(0, 0), square(10, 0)], [], lambda a, b: a, wound=True)
    assert len(one) == 1 and len(one[0]) == 4 and overlay.area2(one[0]) == 400
    (ring,) = overlay.overlay([square(0, 0)], [[np.array([(3, 3), (6, 3), (6, 6), (3, 6)], float)]], overlay.RULES["difference"])
    assert len(ring) == 2 and overlay.area2(ring[0]) + overlay.area2(ring[1]) == 182
    assert overlay.overlay([square(0, 0)], [square(0, 0)], overlay.RULES["xor"]) == []


def test_buffers(spark):
    ell = [(0, 0), (40, 0), (40, 20), (20, 20), (20, 40), (0, 40)]
    df = geometry.literal_geometry(spark, polygons=[[ell]])
    grown = overlay.buffer(df, 5.0).first().polygons
    assert sorted((p.x, p.y) for p in grown[0][0]) == sorted([(-5, -5), (45, -5), (45, 25), (25, 25), (25, 45), (-5, 45)])
    assert overlay.buffer(df, -11.0).count() == 0
    road = overlay.buffer(geometry.literal_geometry(spark, lines=[[(0, 0), (100, 0), (100, 100)]]), 10.0, "round").first().polygons
    rings = [[np.array([(p.x, p.y) for p in r]) for r in polygon] for polygon in road]
    assert abs(sum(overlay.area2(r) for p in rings for r in p) / 2 - (200 * 20 + math.pi * 100 - 21)) < 60
    dot = overlay.buffer(geometry.literal_geometry(spark, points=[(0, 0)]), 10.0, "round").first().polygons
    assert len(dot[0][0]) == 26
    none = geometry.literal_geometry(spark).withColumn("polygons", F.array().cast(geometry.SHAPES["polygons"]))
    assert overlay.buffer(none, 3.0).count() == 0


def test_stitching(spark):
    half = "z int, x int, y int, kind string, polygons " + geometry.SHAPES["polygons"]
    rows = [(2, 0, 1, "a", [[[(4000.0, 10.0), (4160.0, 10.0), (4160.0, 20.0), (4000.0, 20.0)]]]), (2, 1, 1, "a", [[[(-64.0, 10.0), (100.0, 10.0), (100.0, 20.0), (-64.0, 20.0)]]])]
    out = {r.x: r.polygons for r in overlay.stitch(spark.createDataFrame(rows, half), "kind").collect() if r.polygons}
    box = lambda p: (min(q.x for q in p[0][0]), max(q.x for q in p[0][0]))
    assert {x: len(p) for x, p in out.items()} == {0: 1, 1: 1} and box(out[0]) == (4000, 4196) and box(out[1]) == (-96, 100)


def test_voronoi_cells_hold_what_is_nearest():
    rng = np.random.default_rng(2)
    sites = sorted({tuple(p) for p in rng.integers(0, 300, (60, 2)).astype(float).tolist()})
    cells = kernels.voronoi_cells(sites, (-5, -5, 305, 305))
    x, y = rng.random((2, 800)) * 310 - 5
    nearest = np.argmin(np.hypot(x[:, None] - [s[0] for s in sites], y[:, None] - [s[1] for s in sites]), axis=1)
    for i, s in enumerate(sites):
        assert (inside([[np.array(cells[s])]], x, y) == (nearest == i)).mean() > 0.999


def test_fracture_axis_and_pole(spark):
    df = geometry.literal_geometry(spark, polygons=[[[(0, 0), (400, 0), (400, 100), (0, 100)], [(180, 40), (220, 40), (220, 60), (180, 60)]]])
    seeds = F.array(*[geometry.point(F.lit(x), F.lit(50)) for x in (50, 150, 350)])
    pieces = kernels.voronoi_fracture(df.withColumn("seeds", seeds)).collect()
    area = sum(overlay.area2(np.array([(p.x, p.y) for p in r])) for row in pieces for polygon in row.polygons for r in polygon) / 2
    assert len(pieces) == 3 and area == 400 * 100 - 40 * 20
    axis = kernels.medial_axis(geometry.literal_geometry(spark, polygons=[[[(0, 0), (400, 0), (400, 40), (0, 40)]]]), 8.0, 30.0).first().lines
    assert any(all(abs(p.y - 20) <= 1 for p in line) and abs(line[0].x - line[-1].x) > 300 for line in axis)
    pole = kernels.polylabel(df, 0.5).first().points[0]
    assert min(pole.x, 400 - pole.x, pole.y, 100 - pole.y) >= 48 and abs(pole.x - 200) > 60
    assert kernels.polylabel(geometry.literal_geometry(spark, polygons=[[[(3, 5), (9, 5), (6, 5)]]])).first().points[0][:] == (3.0, 5.0)


def test_clipped_lines_leave_and_come_back(spark):
    df = geometry.literal_geometry(spark, lines=[[(-5, 5), (5, 5), (5, 15), (8, 15), (8, 5)], [(0, 0), (10, 0)]], points=[(0, 0), (10, 3)])
    closed = clipping.clip(df, 0, 0, 10, 10).first()
    assert [[(p.x, p.y) for p in line] for line in closed.lines] == [[(0, 5), (5, 5), (5, 10)], [(8, 10), (8, 5)], [(0, 0), (10, 0)]]
    open_ = clipping.clip(df, 0, 0, 10, 10, "ne").first()
    assert len(open_.lines) == 2 and [(p.x, p.y) for p in open_.points] == []


def test_junction_axes(spark):
    arm = lambda x, y: [(0, 0), (x, y)]
    axis = lambda *lines: round(next(r.axis_deg for r in geometry.junctions(geometry.literal_geometry(spark, lines=lines)).collect() if (r.vx, r.vy) == (0, 0)), 3)
    assert axis(arm(9, 0)) == 90 and axis(arm(9, 0), arm(-9, 0)) == 90
    assert axis(arm(9, 0), arm(0, 9)) == 45
    assert axis(arm(9, 0), arm(-9, 0), arm(0, 9)) == 90  # the widest gap is opposite the stem
    snapped = geometry.junctions(geometry.literal_geometry(spark, lines=[arm(9, 0), [(2, 0), (2, 9)], [(4, 0), (9, 9)]]), snap=2.0).collect()
    assert {(r.vx, r.vy, r.arms) for r in snapped} == {(2, 0, 3), (9, 0, 1), (2, 9, 1), (9, 9, 1)}


@pytest.mark.parametrize(("cap", "join"), [("butt", "miter"), ("round", "round"), ("square", "bevel")])
def test_strokes(spark, cap, join):
    """An elbow of 8 pixels' width: its arms, ends and corner."""
    df = geometry.literal_geometry(spark, lines=[[(640, 1280), (2560, 1280), (2560, 3200)]])
    found = {(r.px, r.py) for r in coverage.stroked(df, 64, 8.0, cap, join).collect()}
    assert {(x, y) for x in range(10, 36) for y in range(16, 24)} <= found and {(x, y) for x in range(36, 44) for y in range(24, 50)} <= found
    ends = {"butt": 0, "square": 4 * 8, "round": len([1 for x in range(6, 10) for y in range(16, 24) if (x + 0.5 - 10) ** 2 + (y + 0.5 - 20) ** 2 < 16])}
    assert len({p for p in found if p[0] < 10}) == ends[cap]
    corner = {p for p in found if p[0] >= 40 and p[1] < 20}
    assert {"miter": len(corner) == 16, "round": 10 <= len(corner) <= 15, "bevel": 6 <= len(corner) <= 10}[join]


def test_expressions_of_colours_and_geometry(spark):
    df = spark.range(1).select(F.lit(0).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit("Ärger").alias("name"), F.lit(3.0).alias("n"), F.array(geometry.point(F.lit(2048.0), F.lit(2048.0))).alias("points"))
    on = lambda e: df.select(compile_expression(e, df.columns)).first()[0]
    assert tuple(on(["to-color", "#f00"])) == (1, 0, 0, 1) and tuple(on(["rgba", 0, 255, 0, 0.5])) == (0, 1, 0, 0.5)
    assert tuple(on(["to-color", "nonsense", "rgb(0, 0, 255)"])) == (0, 0, 1, 1)
    assert tuple(on(["interpolate", ["linear"], ["get", "n"], 0, "#000000", 6, "#ffffff"])) == pytest.approx((0.5, 0.5, 0.5, 1))
    assert on(["interpolate", ["cubic-bezier", 0, 0, 1, 1], ["get", "n"], 0, 0, 6, 12]) == pytest.approx(6)
    assert on(["interpolate", ["cubic-bezier", 0.42, 0, 1, 1], ["get", "n"], 0, 0, 6, 1]) == pytest.approx(0.3153568, abs=1e-6)
    assert on(["geometry-type"]) == "Point" and on(["==", ["get", "name"], "ARGER", ["collator", {"case-sensitive": False, "diacritic-sensitive": False}]])
    square = {"type": "Polygon", "coordinates": [[[-10, -10], [10, -10], [10, 10], [-10, 10], [-10, -10]]]}
    assert on(["within", square]) and on(["distance", {"type": "Point", "coordinates": [1, 0]}]) == pytest.approx(111319.49, abs=1)
    assert df.select(switch(F.col("name"), [("x", F.lit(1)), (("Ärger", "y"), F.lit(2))], F.lit(3))).first()[0] == 2
    old = ["all", ["==", "name", "Ärger"], ["!in", "n", 1, 2], ["any", [">", "n", 2], ["==", "$type", "Polygon"]]]
    assert df.where(compile_filter(old, df.columns)).count() == 1
    assert tuple(df.select(compile_color("red", df.columns)).first()[0]) == (1, 0, 0, 1)


def test_properties_tell_null_from_absent(spark):
    df = spark.createDataFrame([('{"a": null, "b": 2}',)], "t string").select(F.parse_json("t").alias("properties"))
    has = lambda n: df.select(compile_expression(["has", n], df.columns)).first()[0]
    assert (has("a"), has("b"), has("c")) == (True, True, False)
    assert df.select(compile_expression(["get", "b"], df.columns)).first()[0] == "2"


def test_style_layers(spark):
    tiles = spark.createDataFrame([(0, 0, 0)], "z int, x int, y int")
    square = geometry.literal_geometry(spark, polygons=[[[(0, 0), (2048, 0), (2048, 2048), (0, 2048)]]]).drop("points", "lines").withColumn("name", F.lit("Here"))
    dots = geometry.literal_geometry(spark, points=[(1024, 1024)]).drop("lines", "polygons").withColumn("name", F.lit("Here"))
    c = translate.Context({"s": square, "p": dots}, tiles, 16)
    paint = lambda **p: {k.replace("_", "-"): v for k, v in p.items()}
    style = {"layers": [
        {"id": "b", "type": "background", "paint": paint(background_color="#000000")},
        {"id": "e", "type": "fill-extrusion", "source": "s", "paint": paint(fill_extrusion_color="#ff0000", fill_extrusion_height=9)},
        {"id": "l", "type": "line", "source": "s", "paint": paint(line_color="#00ff00", line_width=64)},
        {"id": "c", "type": "circle", "source": "p", "paint": paint(circle_color="#0000ff", circle_radius=32)},
        {"id": "h", "type": "heatmap", "source": "p", "paint": paint(heatmap_radius=64)},
        {"id": "t", "type": "symbol", "source": "p", "layout": {"text-field": "{name}!", "text-size": 10}},
        {"id": "no", "type": "sky"}, {"id": "off", "type": "fill", "source": "s", "layout": {"visibility": "none"}},
    ]}
    out = translate.translate(style, c)
    assert list(out) == ["b", "e", "l", "c", "h", "t"] and c.unsupported == ["e: fill-extrusion-height", "no: type sky"]
    assert out["e"].df.count() == 64 and out["c"].df.count() == 4 and out["t"].first().text == "Here!"
    image = {(r.px, r.py): (r.r, r.g, r.b) for r in translate.render({"layers": style["layers"][:3]}, c).df.collect()}
    assert len(image) == 256 and image[3, 3] == (255, 0, 0) and image[0, 3] == (0, 255, 0) and image[12, 12] == (0, 0, 0)
    assert translate.place_symbols(style, c).first().placed


def test_parameters():
    declared = {"w": {"type": "number", "default": 2, "min": 1, "max": 5}, "k": {"type": "string", "default": "a", "enum": ["a", "b"]}}
    assert translate.with_params({"x": ["$w", {"y": "$k"}], "z": "plain"}, declared, {"w": 9}) == {"x": [5, {"y": "a"}], "z": "plain"}
    for wrong in ({"w": "x"}, {"k": "c"}, {"other": 1}):
        with pytest.raises(ValueError):
            translate.with_params({"x": "$w", "y": "$k"}, declared, wrong)
