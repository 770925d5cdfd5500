"""Plans and kernels whose cost grew faster than their tables."""

import io
import math
import time
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import grid as G
from tessera.operators import coverage, field, geometry, kernels, overlay, raster
from tessera.plans import catalog
from tessera.sources import geojson


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def tiles(spark):
    """One pixel in each of 400 tiles."""
    ids = spark.range(400).select(F.lit(9).alias("z"), (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"))
    return ids.select("z", "x", "y", F.lit(3).alias("px"), F.lit(2).alias("py"))


def test_dense_deals_once(tiles):
    g = G.Grid(tiles.withColumn("v", F.lit(1.5)), 8, 8)
    p = plan(G.neighbourhoods(g))
    assert p.count("Exchange") == 1 and "Union" not in p
    rows = G.dense(g).df
    assert rows.count() == 400 * 64 and rows.where("v = 1.5 AND px = 3 AND py = 2").count() == rows.where("v IS NOT NULL").count() == 400
    most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 400 * 64 / 2  # one small list of tiles became one task before


@pytest.mark.parametrize("mode", ["average", "middle"])
def test_mosaic_deals_once(tiles, mode):
    g = G.Grid(tiles.select(*G.PIXEL, *[F.lit(90).alias(c) for c in G.BANDS]), 8, 8)
    out = raster.mosaic(g, 3.0, mode).df
    assert plan(out).count("Exchange") == 1 and out.count() == 400 * 64


def test_warp_sends_no_lattice_around(tiles):
    g = G.Grid(tiles.select(*G.PIXEL, *[F.lit(90).alias(c) for c in G.BANDS]), 8, 8)
    out = raster.warp(g, 8.0, 3.0).df
    p = plan(out)
    assert p.count("Join") == 1 and out.count() == 400 * 64


def test_flow_of_whole_slopes(spark):
    """Planes whose slopes make colours that end in a half: what rounding makes of them depends on the last bit."""
    planes = [(k * a, k * b) for a, b in ((3, 4), (8, 15), (13, 84), (36, 77), (40, 75), (24, 45)) for k in range(1, 60)]
    planes += [(b, a) for a, b in planes]
    rows = [(9, i, 0, px, py, float(a * px + b * py)) for i, (a, b) in enumerate(planes) for px in range(3) for py in range(3)]
    f = G.Grid(spark.createDataFrame(rows, "z int, x int, y int, px int, py int, v double"), 3, 3, 30.0)
    found = {r.x: (r.r, r.g) for r in field.flow_field(f).df.where("px = 1 AND py = 1").collect()}
    for i, (a, b) in enumerate(planes):
        gx, gy = 8 * a / 240, 8 * b / 240
        m = math.sqrt(gx * gx + gy * gy)
        share = min(math.atan(m) / math.radians(45), 1.0)
        assert found[i] == tuple(math.floor((0.5 + 0.5 * (-g / m * share)) * 255 + 0.5) for g in (gx, gy)), (a, b)


def test_sums_on_a_step(spark, tmp_path):
    """Values that make 50, but just less when added in this order."""
    low = [1.3, 7.64, 6.9, 2.37, 4.51, 4.1, 5.9, 7.12, 0.94, 9.22]
    total = 0.0
    for v in low:
        total += v
    assert total < 50 == round(total, 9)
    rows = [(0, 0, "click", v) for v in low]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).selectExpr("*", "timestamp'2020-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    (row,) = catalog.QUERIES["density_ramp"](spark, str(tmp_path)).collect()
    assert (row.r, row.g, row.b) == (0x30, 0x60, 0xC0)


def test_overlay_on_a_grid_of_many_rectangles():
    """As many as one square of a tile holds at 0.1 GB: the edges' crossings, taken pair by pair, were millions."""
    rng = np.random.default_rng(5)
    x, y, w, h = rng.integers(0, 900, 4000), rng.integers(0, 900, 4000), rng.integers(16, 120, 4000), rng.integers(16, 120, 4000)
    own = [[np.array([(a, b), (a + c, b), (a + c, b + d), (a, b + d)], float)] for a, b, c, d in zip(x, y, w, h)]
    box = [[np.array([(200, 200), (800, 200), (800, 800), (200, 800)], float)]]
    count = np.zeros((1024, 1024), int)
    for a, b, c, d in zip(x, y, w, h):
        count[b : b + d, a : a + c] += 1
    second = np.zeros((1024, 1024), bool)
    second[200:800, 200:800] = True
    began = time.process_time()
    for mode, rule in overlay.RULES.items():
        found = overlay.overlay(own, box, rule)
        assert sum(overlay.area2(r) for p in found for r in p) / 2 == rule(count % 2 == 1, second).sum(), mode
        assert all(overlay.area2(r) > 0 for p in found for r in p[:1]) and all(overlay.area2(r) < 0 for p in found for r in p[1:])
    assert sum(overlay.area2(r) for p in overlay.overlay(own, [], lambda a, b: a, wound=True) for r in p) / 2 == (count > 0).sum()
    assert time.process_time() - began < 120


def test_squares_are_dealt_out_and_copies_cancel(spark):
    """Few bytes are much work: squares are not put together to one task."""
    tile = "z int, x int, y int, polygons " + geometry.SHAPES["polygons"]
    square = [[[(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]]]
    rows = spark.createDataFrame([(5, i % 8, i // 8, square) for i in range(32)] * 2, tile)
    none = rows.where("false")
    assert overlay.feature_boolean(rows, none).count() == 0  # by even and odd crossings, twice is not at all
    out = overlay.dissolve(rows)
    assert out.count() == 32 and out.rdd.getNumPartitions() == 4


def test_shapes_are_worked_out_once(spark):
    seen = []
    known = kernels._Remembered(lambda polygons, points: seen.append(points) or polygons)
    box = lambda x, y: [[[{"x": x + a, "y": y + b} for a, b in ((0.0, 0.0), (30.0, 0.0), (30.0, 20.0), (0.0, 20.0))]]]
    for i in range(50):
        found, dx, dy = known(box(7.0 * i, 11.0 * i), [{"x": 7.0 * i + 3, "y": 11.0 * i + 4}])
        assert (dx, dy) == (7.0 * i, 11.0 * i) and found[0][0][2] == (30.0, 20.0)
    assert len(seen) == 1
    rows = spark.createDataFrame([(box(7.0 * i, 11.0 * i),) for i in range(50)], "polygons " + geometry.SHAPES["polygons"])
    assert kernels._by_shape(rows, "polygons").groupBy(F.spark_partition_id()).count().count() == 1
    assert {(r.points[0].x, r.points[0].y) for r in kernels.polylabel(rows).collect()} == {(7.0 * i + 15, 11.0 * i + 10) for i in range(50)}


def test_medial_axis_is_the_same_at_every_place():
    """Corners of cells at 128ths were rounded either way, and lines broken there."""
    for x, y, w, h in [(834, 1247, 102, 159), (3336, 2613, 160, 213), (1025, 2413, 191, 213), (2262, 2976, 114, 160)]:
        ring = lambda x, y, w=w, h=h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        here, there = kernels._axis([ring(float(x), float(y))], 32.0, 0.0), kernels._axis([ring(0.0, 0.0)], 32.0, 0.0)
        assert here == [[(p[0] + x, p[1] + y) for p in line] for line in there]


def test_seeds_not_points_are_shown_in_nine_cells(spark):
    points = spark.range(200).select(F.lit(1).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), "id", (F.col("id") * 97 % 4096).alias("vx"), (F.col("id") * 641 % 4096).alias("vy"))
    seeds = spark.range(500).select(F.lit(1).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("id").alias("seed_ix"), (F.col("id") * 211 % 4096).alias("sx"), (F.col("id") * 389 % 4096).alias("sy"))
    out = geometry.nearest_seed(points, seeds, 2.0)
    exploded = [line for line in plan(out).splitlines() if "Generate" in line]
    assert exploded and not any("vx" in line for line in exploded)
    for r in out.collect():
        best = min(((i * 211 % 4096 - r.vx) ** 2 + ((i * 389 % 4096 - r.vy) * 2.0) ** 2, i) for i in range(500))
        assert r.seed_ix == best[1]


def test_what_lies_under_opaque_rows_is_left_out(spark):
    rows = spark.range(1000).select(F.lit(0).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("id") % 4).cast("int").alias("px"), F.lit(0).alias("py"), F.col("id").alias("feature_ix"),
                                    *[F.lit(0.5).alias(f"p_{c}") for c in "rgb"], F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.5).alias("p_a"))
    kept = coverage._above_opaque(rows, ["feature_ix"])
    assert kept.where("px = 0").agg(F.min("feature_ix")).first()[0] == 980 and kept.where("px = 1").count() == 250
    assert kept.count() == coverage._above_opaque(rows, ["feature_ix"], most=0).count() < 600


def test_overlay_of_many_rings():
    """Areas were worked out ring by ring, several times each."""
    own = [[np.array([(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2)], float)] for x in range(0, 800, 4) for y in range(0, 800, 4)]
    began = time.process_time()
    found = overlay.overlay(own, [], overlay.RULES["union"])
    assert time.process_time() - began < 6
    assert [p[0].min(0).tolist() for p in found] == [p[0][0].tolist() for p in own] and all(len(p) == 1 for p in found)


def test_polygons_are_dealt_out_before_they_are_counted_and_clipped(spark):
    tile = "z int, x int, y int, polygons " + geometry.SHAPES["polygons"]
    rows = spark.createDataFrame([(5, 0, 0, [[[(float(i), 10.0), (i + 20.0, 10.0), (i + 20.0, 20.0), (float(i), 20.0)]]]) for i in range(0, 4000, 50)], tile)
    for out in (overlay.feature_boolean(rows, rows.limit(1), "xor", cells=2), overlay.dissolve(rows, cells=2)):
        assert plan(out).count("REPARTITION_BY_NUM") == 2  # only squares were dealt out before: each split's polygons were clipped and kept in one map
    assert overlay._copies(rows.select("z", "x", "y", F.explode("polygons").alias("p"))).rdd.getNumPartitions() >= G.TASKS


def test_geojson_shapes_are_worked_out_once(spark):
    texts = spark.createDataFrame([('{"type":"Point","coordinates":[5,6]}',), ('{"type":"Point","coordinates":[500,6]}',), ("[]",), ("no",), ('{"type":"LineString","coordinates":[]}',)], "json string")
    out = geojson.tiled(geojson.decode(texts), 4)
    assert not [line for line in plan(out).splitlines() if "Filter" in line and "from_json" in line]  # filters repeated what they look at
    (row,) = geometry.every_vertex(out).collect()
    assert (row.x, row.y, row.of_, row.part, row.i) == (8, 7, "points", 0, 0)


def test_geojson_texts_are_decoded_once(spark):
    p = plan(catalog.QUERIES["geojson_tiled"](spark, "/root/testdata/sf0.001"))
    assert p.count("FileScan") == 1 and "REPARTITION_BY_NUM" in p  # a scan and a decoding for each kind of shape


def test_tiles_are_dealt_into_many_tasks(tiles):
    """A task holds all it sorts and counts; as many tasks as shuffles have were too few for large tables."""
    assert "REPARTITION_BY_NUM" in plan(G.dense(G.Grid(tiles.withColumn("v", F.lit(1.5)), 8, 8)).df)
    assert G.dealt(tiles).rdd.getNumPartitions() >= G.TASKS


@pytest.mark.parametrize("boundary", ["clamp", "wrap", "mirror", "transparent"])
def test_taps_are_looked_up_in_their_tile(spark, tiles, boundary):
    """Taps were four times the pixels, joined and summed in as many tasks as shuffles have."""
    g = G.Grid(tiles.where("x <> 0").select(*G.PIXEL, *[F.lit(v).alias(c) for c, v in zip(G.BANDS, (90, 60, 30, 120))]), 8, 8)
    by = G.Grid(tiles.select(*G.TILE, (F.col("x") % 8).alias("px"), F.lit(1).alias("py"), F.lit(200).alias("r"), F.lit(255).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a")), 8, 8)
    out = raster.displace(g, by, 6.0, 3.0, boundary).df
    p = plan(out)
    assert p.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in p and not [line for line in p.splitlines() if "Generate" in line and "sequence" not in line]
    rows = out.collect()
    assert len(rows) == 400 * 64

    def place(q, n=8):
        return {"clamp": min(max(q, 0), n - 1), "wrap": q % n, "mirror": min(q % (2 * n), 2 * n - 1 - q % (2 * n)), "transparent": q}[boundary]

    for r in rows[::7]:
        own = (r.px, r.py) == (r.x % 8, 1)
        sx, sy = r.px + ((200 if own else 0) / 255 - 0.5) * 12, r.py + ((255 if own else 0) / 255 - 0.5) * 6
        fx, fy = math.floor(sx), math.floor(sy)
        k = sum((1 - abs(sx - fx - i)) * (1 - abs(sy - fy - j)) for i in (0, 1) for j in (0, 1) if r.x != 0 and (place(fx + i), place(fy + j)) == (3, 2))
        assert [r[c] for c in G.BANDS] == [math.floor(round(k * v, 9) + 0.5) for v in (90, 60, 30, 120)]


def test_taps_of_a_field_skip_what_is_missing(spark):
    f = G.Grid(spark.createDataFrame([(1, 0, 0, 0, 0, 10.0), (1, 0, 0, 1, 0, 20.0)], "z int, x int, y int, px int, py int, v double"), 2, 2)
    at = spark.createDataFrame([(1, 0, 0, 0, 0, 0.25, 0.5), (1, 0, 0, 1, 0, 0.0, 1.0), (1, 1, 0, 0, 0, 0.0, 0.0)], "z int, x int, y int, px int, py int, sx double, sy double")
    assert {(r.x, r.px): r.v for r in raster._taps(f, at, "clamp").collect()} == {(0, 0): 12.5, (0, 1): None, (1, 0): None}


def test_overlay_looks_only_where_something_can_be_left(monkeypatch):
    """The whole square's coordinates made the grid, also where the other side has nothing."""
    rng = np.random.default_rng(7)
    box = lambda x, y, w, h: [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)]
    own = [box(*rng.integers(0, 900, 2), *rng.integers(16, 120, 2)) for _ in range(500)]
    second = [box(300, 400, 40, 30), box(310, 410, 10, 10)]
    count = np.zeros((2, 1024, 1024), int)
    for k, ps in enumerate((own, second)):
        for (r,) in ps:
            (x0, y0), (x1, y1) = r.min(0).astype(int), r.max(0).astype(int)
            count[k, y0:y1, x0:x1] += 1
    sizes, kernel = [], overlay._gridded
    monkeypatch.setattr(overlay, "_gridded", lambda *a: sizes.append((len(a[4]), len(a[5]))) or kernel(*a))
    for mode, rule in overlay.RULES.items():
        for a, b, m, n in ((own, second, 0, 1), (second, own, 1, 0)):
            found = overlay.overlay(a, b, rule)
            assert sum(overlay.area2(r) for p in found for r in p) / 2 == rule(count[m] % 2 == 1, count[n] % 2 == 1).sum(), mode
            if mode == "intersection":
                assert max(sizes.pop()) <= 41
    assert overlay.overlay(own, [], overlay.RULES["intersection"]) == overlay.overlay([], own, overlay.RULES["difference"]) == []
    assert overlay.overlay([box(0, 0, 5, 5)], [box(5, 0, 5, 5)], overlay.RULES["intersection"]) == []
    assert overlay.overlay([box(0, 0, 5, 5)], [box(9, 9, 5, 5)], overlay.RULES["intersection"]) == []


def test_polygons_along_the_axes_are_moved_into_squares(spark):
    """Each side of a square was cut off by itself, crossing by crossing; what is enclosed must stay the same."""
    bent = [[(100.0, 100.0), (4000.0, 100.0), (4000.0, 900.0), (1500.0, 900.0), (1500.0, 3000.0), (4000.0, 3000.0), (4000.0, 3900.0), (100.0, 3900.0)], [(200.0, 200.0), (200.0, 3000.0), (1200.0, 3000.0), (1200.0, 200.0)]]
    rows = spark.createDataFrame([(5, 0, 0, bent), (5, 0, 0, [[(10.0, 10.0), (3000.0, 20.0), (30.0, 4000.0)]])], "z int, x int, y int, p " + geometry.SHAPES["lines"])
    found = overlay._in_cells(rows, 4, 0, 4096)
    assert "upright" in plan(found)
    areas = {}
    for r in found.collect():
        assert all(max(0, r.cx * 1024) <= q.x <= r.cx * 1024 + 1024 and r.cy * 1024 <= q.y <= r.cy * 1024 + 1024 for ring in r.p for q in ring)
        kind = all(a.x == b.x or a.y == b.y for ring in r.p for a, b in zip(ring, [*ring[1:], ring[0]]))
        areas[kind] = areas.get(kind, 0) + sum(overlay.area2(np.array([(q.x, q.y) for q in ring])) / 2 for ring in r.p)
    assert areas[True] + areas.get(False, 0) == pytest.approx(3900 * 3800 - 2500 * 2100 - 1000 * 2800 + (2990 * 3990 - 20 * 10) / 2, rel=1e-3)


@pytest.mark.parametrize("name, deals", [("blur_field", 1), ("sharpen_field", 1), ("contour_segments", 1), ("displace", 2), ("blend_normal", 2)])
def test_lifts_are_dealt_before_they_are_summed(spark, name, deals):
    """Each split's sums were held in one map first, which grew with it, and then went to as many tasks as shuffles have."""
    p = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert p.count("REPARTITION_BY_NUM") == deals and "ENSURE_REQUIREMENTS" not in p


def _zigzags(spark, n=200):
    """Lines that zigzag over a tile of 8 pixels, every third opaque, and one that does not cover its tile."""
    rows = [(5, i % 2, 0, i, [[(float(i * 37 % 512), 0.0), (float(i * 91 % 512), 511.0), (511.0, float(i * 53 % 512)), (0.0, float(i * 29 % 512))]]) for i in range(n)] + [(5, 3, 0, 7, [[(0.0, 0.0), (99.0, 99.0)]])]
    return spark.createDataFrame(rows, "z int, x int, y int, feature_ix long, lines " + geometry.SHAPES["lines"])


def _paint():
    i = F.col("feature_ix")
    return F.struct((i % 7 / 7).alias("r"), F.lit(0.25).alias("g"), F.lit(0.5).alias("b"), F.when(i % 3 == 0, 1.0).otherwise(0.5).alias("a"))


@pytest.mark.parametrize("front", [0, 1, 3, 8, 512])
def test_strokes_under_opaque_ones_are_not_drawn(spark, monkeypatch, front):
    """All strokes were drawn twice and shuffled whole, however many lie under opaque ones."""
    df, seen, parts = _zigzags(spark), [], coverage._stroked_parts
    plain = coverage.paint(coverage.stroked(df.withColumns(coverage._paint_columns(_paint(), 1.0)), 8, 1.5, "round", "round", extent=512), 8).df
    monkeypatch.setattr(coverage, "FRONT", front)
    monkeypatch.setattr(coverage, "_stroked_parts", lambda f, *a: seen.append(f.count()) or parts(f, *a))
    found = coverage.stroke(df, 8, _paint(), 1.5, cap="round", join="round", extent=512).df
    assert sorted(found.collect()) == sorted(plain.collect()) and found.count() > 128
    assert seen[-1] < 120 and (front not in (3, 8) or seen[0] == 2 * front)


def test_disks_under_opaque_ones_are_not_shuffled(spark):
    """Each feature's pixels were shuffled before those under opaque ones were left out."""
    rows = [(5, 0, 0, i, [(float(i * 37 % 512), float(i * 91 % 512)), (float(i * 53 % 512), float(i * 29 % 512))][: 1 + i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "z int, x int, y int, feature_ix long, points " + geometry.SHAPES["points"])
    for rim in (0.75, 1.0):
        ink = {**coverage._paint_columns(_paint(), 1.0), **{f"{n}_rim": c for n, c in coverage._paint_columns("#ffffff", rim).items()}}
        whole = coverage.disks(df.withColumns(ink), 8, 1.5, 1.0, extent=512)
        whole = whole.withColumns({c: F.when(F.col("rim"), F.col(f"{c}_rim")).otherwise(F.col(c)) for c in ("p_r", "p_g", "p_b", "p_a")})
        found = coverage.circles(df, 8, 1.5, _paint(), stroke_width=1.0, stroke_color="#ffffff", stroke_opacity=rim, extent=512).df
        p = plan(found)
        assert sorted(found.collect()) == sorted(coverage.paint(whole, 8).df.collect())
        assert p.count("Exchange hashpartitioning") == p.count("REPARTITION_BY_COL") == 1 and p.index("REPARTITION_BY_COL") < p.index("BroadcastHashJoin")


def test_tops_are_not_sorted(spark):
    """A struct as the greatest of a group made Spark sort every row."""
    rows = spark.range(10).select(*[F.lit(0).alias(c) for c in G.PIXEL], F.col("id").alias("feature_ix"), F.lit(1.0).alias("p_a"))
    assert "Sort" not in plan(rows.groupBy(*G.PIXEL).agg(F.max(coverage._rank(["feature_ix"])))) and coverage._tops(rows, ["feature_ix"]).first().top == 9


def test_convex_polygons_are_buffered_together():
    """Each polygon was taken by itself, at most of a millisecond."""
    rng = np.random.default_rng(4)
    x, y, w, h = rng.integers(0, 3800, 20000), rng.integers(0, 3800, 20000), rng.integers(1, 200, 20000), rng.integers(1, 200, 20000)
    ring = lambda x0, y0, x1, y1: [[{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]
    rows = [[ring(a, b, a + c, b + d)] for a, b, c, d in zip(x, y, w, h)]
    rows[7], rows[9] = [], [rows[9][0], [[{"x": float(a), "y": float(b)} for a, b in ((0, 0), (40, 0), (0, 10), (40, 10))][:2]], rows[8][0]]
    given = pa.array([[], *rows], overlay.POLYGONS).slice(1)
    for distance in (10.0, -9.0):
        began = time.process_time()
        found = overlay._buffered_polygons(given, distance, "miter", math.radians(5))
        assert time.process_time() - began < 2
        moved = [ring(a - distance, b - distance, a + c + distance, b + d + distance) if c > -2 * distance and d > -2 * distance else None for a, b, c, d in zip(x, y, w, h)]
        want = [[m] if m else [] for m in moved]
        want[7], want[9] = [], want[9] + want[8]
        assert found.to_pylist() == want


@pytest.mark.parametrize("join", ["miter", "bevel", "round"])
def test_corners_of_buffers_of_other_polygons(join):
    """Rings of all sizes and both directions in one go: sides lie as far out as asked, in the given order."""
    t = [(np.arange(n) + np.random.default_rng(n).random((40, n)) / 2) / n * 2 * math.pi for n in range(3, 8)]
    rings = [np.round(np.column_stack([2000 + 900 * np.cos(a), 2000 + 700 * np.sin(a)]))[:: 1 - i % 2 * 2] for i, a in enumerate(a for g in t for a in g)]
    found = overlay._buffered_polygons(pa.array([overlay._structs([[r]]) for r in rings], overlay.POLYGONS), 30.0, join, 0.0).to_pylist()
    for r, row in zip(rings, found):
        ((out,),) = row
        r, out = (r if overlay.area2(r) > 0 else r[::-1]), np.array([(p["x"], p["y"]) for p in out])
        step = np.roll(r, -1, 0) - r
        u = step / np.hypot(*step.T)[:, None]
        far = (u[:, 1] * (out[:, None, 0] - r[:, 0]) - u[:, 0] * (out[:, None, 1] - r[:, 1])).max(0)
        assert np.abs(far - 30).max() < 1.5 and (join == "round" or len(out) == len(r) * (1 if join == "miter" else 2))


def test_buffers_are_worked_out_once(spark):
    p = plan(catalog.QUERIES["buffer_polygons"](spark, "/root/testdata/sf0.001"))
    assert p.count("ArrowEvalPython") == 1  # the filter had them worked out for itself
