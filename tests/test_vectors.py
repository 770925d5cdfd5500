"""Hand vectors for rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.arith import apply, fold
from tessera.functions.expressions import compile_expression, compile_filter
from tessera.operators import field, geometry, kernels, labels, raster
from tessera.operators.grid import Grid


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_math_guards(spark):
    assert one(spark, apply("div", F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, apply("log", F.lit(-1.0))) is None
    assert one(spark, apply("mod", F.lit(-7.0), F.lit(3.0))) == 2.0
    assert one(spark, apply("round", F.lit(-2.5))) == -3.0
    assert fold("smoothstep", 1, 1, 1) == 1.0
    with pytest.raises(ArithmeticError):
        fold("div", 1, 0)


def line(spark, *points):
    return geometry.literal_geometry(spark, lines=[points])


def got(df, of="lines"):
    return [(int(r.vx), int(r.vy)) for r in geometry.vertices(df, of).orderBy("part" if of != "points" else "i", "i").collect()]


def test_lines(spark):
    assert got(geometry.densify(line(spark, (0, 0), (20, 0)), 5)) == [(0, 0), (5, 0), (10, 0), (15, 0), (20, 0)]
    assert got(geometry.resample(line(spark, (0, 0), (100, 0)), 25)) == [(0, 0), (25, 0), (50, 0), (75, 0), (100, 0)]
    assert got(geometry.dash(line(spark, (0, 0), (10, 0)), 3, 2)) == [(0, 0), (3, 0), (5, 0), (8, 0)]
    assert got(geometry.dash(line(spark, (0, 0), (10, 0)), 0, 2)) == []
    assert got(kernels.simplify(line(spark, (0, 0), (5, 1), (10, 0)), 2.0)) == [(0, 0), (10, 0)]


def test_hole_is_outside(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    df = geometry.literal_geometry(spark, polygons=[[ring, [(3, 3), (6, 3), (6, 6), (3, 6)]]])
    assert df.select(geometry.contains(df, F.lit(1.0), F.lit(1.0)), geometry.contains(df, F.lit(4.0), F.lit(4.0))).first() == (True, False)
    assert got(geometry.centroid(df), "points") == [(5, 5)]


def test_terrain_and_contours(spark):
    rows = [(0, 0, 0, x, y, float(x) if (x, y) != (1, 1) else None) for x in range(3) for y in range(3)]
    ramp = Grid(spark.createDataFrame(rows, "z int, x int, y int, px int, py int, v double"), 3, 3)
    grey = {(r.px, r.py) for r in field.slope(ramp).df.collect()}
    assert (1, 1) not in grey and len(grey) == 8
    full = ramp.with_df(ramp.df.fillna(1.0, ["v"]))
    assert field.contour_segments(full, [0.5]).count() == 2
    assert field.contour_lines(field.contour_segments(full, [0.5])).count() == 3


def test_source_over_is_exact(spark):
    px = lambda *c: Grid(spark.createDataFrame([(0, 0, 0, 0, 0, *c)], "z int, x int, y int, px int, py int, r int, g int, b int, a int"), 1, 1)
    assert tuple(raster.blend(px(255, 0, 0, 255), px(0, 64, 0, 128)).df.first())[5:] == (127, 64, 0, 255)
    assert tuple(raster.stack([px(255, 0, 0, 255), px(0, 64, 0, 128)]).df.first())[5:] == (127, 64, 0, 255)


def test_labels_touching_do_not_collide(spark):
    rows = [(0, 0, 0, 0, 1, 1, "a", 0.0, 0.0, 5.0, 5.0), (0, 0, 0, 0, 2, 2, "b", 10.0, 0.0, 5.0, 5.0), (0, 0, 0, 0, 3, 3, "c", 5.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "z int, x int, y int, layer_ix int, cand_ix long, sort_key long, text string, wax double, way double, half_w double, half_h double")
    assert {r.cand_ix: r.placed for r in labels.label_placement(df).collect()} == {1: True, 2: True, 3: False}


def test_label_variants_and_overlap(spark):
    """The second label moves aside, the third has no room, the fourth may always overlap, the fifth only meets it."""
    at = lambda i, x, variants, overlap, ignored=False: (0, 0, 0, 0, i, i, "t", float(x), 0.0, 5.0, 5.0, variants, overlap, ignored)
    rows = [at(1, 0, None, None), at(2, 4, [(0.0, 0.0), (0.0, 12.0)], None), at(3, 2, [(0.0, 0.0), (0.0, 8.0)], "never"), at(4, 3, None, "always"), at(5, 100, None, "cooperative"), at(6, 101, None, "cooperative"), at(7, 102, None, None), at(8, 200, None, None, True), at(9, 200, None, None)]
    df = spark.createDataFrame(rows, "z int, x int, y int, layer_ix int, cand_ix long, sort_key long, text string, wax double, way double, half_w double, half_h double, variants array<struct<dx:double,dy:double>>, overlap string, ignored boolean")
    out = {r.cand_ix: (r.placed, r.variant) for r in labels.label_placement(df).collect()}
    assert out == {1: (True, 0), 2: (True, 1), 3: (False, None), 4: (True, 0), 5: (True, 0), 6: (True, 0), 7: (False, None), 8: (True, 0), 9: (True, 0)}


def test_expressions(spark):
    df = spark.createDataFrame([(4, "park", 12.0), (4, None, None)], "z int, kind string, n double")
    size = compile_expression(["interpolate", ["exponential", 2], ["zoom"], 0, 0, 8, 255], df.columns)
    assert df.select(size).first()[0] == pytest.approx(15.0)
    assert df.where(compile_filter(["==", ["get", "kind"], "park"], df.columns)).count() == 1
    assert df.where(compile_filter(["!has", "kind"], df.columns)).count() == 1


def test_hull_contains_all(spark):
    rows = [(0, 0, 0, float(x), float(y)) for x in range(5) for y in range(5)]
    hull = kernels.convex_hull(spark.createDataFrame(rows, "z int, x int, y int, vx double, vy double")).collect()
    assert {(r.vx, r.vy) for r in hull} == {(0, 0), (4, 0), (0, 4), (4, 4)}
