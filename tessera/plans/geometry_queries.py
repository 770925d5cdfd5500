"""Queries of the geometry, label and expression operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.expressions import compile_expression, compile_filter
from ..functions import mercator
from ..operators import clipping, kernels, labels
from ..operators import geometry as O
from ..sources.lift import lifted
from .registry import micro, query, sql_draw

FK = "z, x, y, feature_ix"
LV = "lift_line_vertices"


def lines(spark, d):
    v = lifted(spark, d, LV)
    p = F.transform(F.sort_array(F.collect_list(F.struct("i", "vx", "vy"))), lambda q: O.point(q["vx"], q["vy"]))
    own = v.groupBy("z", "x", "y", "feature_ix").agg(F.array(p).alias("lines"))  # a line's own vertices
    # Few bytes are much work: lines are not put together to one task.
    return own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "feature_ix")


def rects(spark, d):
    r = lifted(spark, d, "lift_rects")
    return r.select("z", "x", "y", "feature_ix", "kind", "value", F.array(F.array(O.rectangle(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))).alias("polygons"))


def points(spark, d):
    p = lifted(spark, d, "lift_tiled")
    fx, fy = (F.col("lon") + 180) / 360 * 16, (1 - F.asinh(F.tan(F.radians("lat"))) / F.pi()) / 2 * 16
    return p.select("z", "x", "y", "feature_ix", "kind", "value", F.floor((fx - F.floor(fx)) * 4096).alias("vx"), F.floor((fy - F.floor(fy)) * 4096).alias("vy"))


def _verts(df, of="lines"):
    out = O.vertices(df, of)
    return out.select(*[c for c in ("z", "x", "y", "feature_ix", "part", "ring", "i") if c in out.columns], F.col("vx").cast("long").alias("vx"), F.col("vy").cast("long").alias("vy"))


#: Segments with the length before each, per line.
SEG = f"""s AS (SELECT {FK}, i, vx AS ax, vy AS ay, lead(vx) OVER w AS bx, lead(vy) OVER w AS by_ FROM lift_line_vertices WINDOW w AS (PARTITION BY {FK} ORDER BY i)), g AS (SELECT *, sqrt(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE)) AS l FROM s WHERE bx IS NOT NULL)"""
I = lambda e, n: f"CAST({e} AS BIGINT) AS {n}"  # noqa: E731,E741

query("bbox", "SELECT z, x, y, CAST(min(vx) AS BIGINT) AS x0, CAST(min(vy) AS BIGINT) AS y0, CAST(max(vx) AS BIGINT) AS x1, CAST(max(vy) AS BIGINT) AS y1 FROM lift_line_vertices GROUP BY z, x, y", LV)(
    lambda spark, d: O.bbox(lines(spark, d)).select("z", "x", "y", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]))
query("boundary", f"SELECT {FK}, 0 AS part, i, CAST(CASE WHEN i IN (0, 3, 4) THEN x0 ELSE x1 END AS BIGINT) AS vx, CAST(CASE WHEN i IN (0, 1, 4) THEN y0 ELSE y1 END AS BIGINT) AS vy FROM lift_rects, (VALUES (0), (1), (2), (3), (4)) AS k(i)", "lift_rects")(
    lambda spark, d: _verts(O.boundary(rects(spark, d))))
query("centroid_polygons", f"SELECT {FK}, CAST(round((x0 + x1) / CAST(2 AS DOUBLE)) AS BIGINT) AS vx, CAST(round((y0 + y1) / CAST(2 AS DOUBLE)) AS BIGINT) AS vy FROM lift_rects", "lift_rects")(
    lambda spark, d: _verts(O.centroid(rects(spark, d)), "points").drop("i"))
query("centroid_lines", f"WITH {SEG} SELECT {FK}, CAST(round(sum((ax + bx) / CAST(2 AS DOUBLE) * l) / sum(l)) AS BIGINT) AS vx, CAST(round(sum((ay + by_) / CAST(2 AS DOUBLE) * l) / sum(l)) AS BIGINT) AS vy FROM g GROUP BY {FK}", LV)(
    lambda spark, d: _verts(O.centroid(lines(spark, d).where(F.size(F.col("lines")[0]) > 1)), "points").drop("i"))
_C, _S = math.cos(math.radians(30)), math.sin(math.radians(30))
query("transform", f"SELECT {FK}, 0 AS part, i, CAST(round((vx - 2048) * 2.0 * {_C!r} - (vy - 2048) * 0.5 * {_S!r} + 2048 + 10) AS BIGINT) AS vx, CAST(round((vx - 2048) * 2.0 * {_S!r} + (vy - 2048) * 0.5 * {_C!r} + 2048 - 20) AS BIGINT) AS vy FROM lift_line_vertices", LV)(
    lambda spark, d: _verts(O.transform(lines(spark, d), (2.0, 0.5), 30.0, (10.0, -20.0))))
query("smooth", f"""WITH {SEG}, n AS (SELECT {FK}, count(*) AS n FROM lift_line_vertices GROUP BY {FK}), q AS (
SELECT {FK}, CAST(1 + 2 * i AS INT) AS i, CAST(round(0.75 * ax + 0.25 * bx) AS BIGINT) AS vx, CAST(round(0.75 * ay + 0.25 * by_) AS BIGINT) AS vy FROM g UNION ALL SELECT {FK}, CAST(2 + 2 * i AS INT), CAST(round(0.25 * ax + 0.75 * bx) AS BIGINT), CAST(round(0.25 * ay + 0.75 * by_) AS BIGINT) FROM g
UNION ALL SELECT {FK}, CAST(CASE WHEN i = 0 THEN 0 ELSE 2 * i + 1 END AS INT), vx, vy FROM lift_line_vertices JOIN n USING ({FK}) WHERE i = 0 OR i = n - 1)
SELECT {FK}, 0 AS part, q.i, q.vx, q.vy FROM q JOIN n USING ({FK}) WHERE n >= 3 UNION ALL SELECT {FK}, 0, i, vx, vy FROM lift_line_vertices JOIN n USING ({FK}) WHERE n < 3""", LV)(
    lambda spark, d: _verts(O.smooth(lines(spark, d))))
query("densify", f"""WITH {SEG}, k AS (SELECT *, CAST(greatest(ceil(l / 500), 1) AS BIGINT) AS n FROM g), e AS (SELECT *, unnest(range(n)) AS k FROM k),
o AS (SELECT {FK}, i, k, CASE WHEN k = 0 THEN ax ELSE CAST(round(ax + (bx - ax) * (k / CAST(n AS DOUBLE))) AS BIGINT) END AS vx, CASE WHEN k = 0 THEN ay ELSE CAST(round(ay + (by_ - ay) * (k / CAST(n AS DOUBLE))) AS BIGINT) END AS vy FROM e UNION ALL SELECT {FK}, i, 0, ax, ay FROM s WHERE bx IS NULL)
SELECT {FK}, 0 AS part, CAST(row_number() OVER (PARTITION BY {FK} ORDER BY i, k) - 1 AS INT) AS i, vx, vy FROM o""", LV)(lambda spark, d: _verts(O.densify(lines(spark, d), 500)))  # fmt: skip
#: The same with the distance before each segment (at_) and the line's length (total).
MEASURED = f"""{SEG}, m AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY {FK} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_,
sum(l) OVER (PARTITION BY {FK}) AS total FROM g)"""
ON = "CAST(round(ax + (bx - ax) * ({t})) AS BIGINT) AS vx, CAST(round(ay + (by_ - ay) * ({t})) AS BIGINT) AS vy"

query("resample", f"""WITH {MEASURED}, t AS (SELECT *, CAST(round(total / 700) AS BIGINT) AS n FROM m),
k AS (SELECT *, unnest(range(CAST(floor(at_ * n / total + 0.000000000001) AS BIGINT) + 1, least(CAST(floor((at_ + l) * n / total + 0.000000000001) AS BIGINT), n - 1) + 1)) AS k
  FROM t WHERE n >= 2 AND total >= 700),
o AS (SELECT {FK}, i, k, {ON.format(t="(k * (total / n) - at_) / l")} FROM k
UNION ALL SELECT {FK}, -1, 0, vx, vy FROM lift_line_vertices JOIN (SELECT DISTINCT {FK} FROM t WHERE n >= 2 AND total >= 700) USING ({FK}) WHERE i = 0
UNION ALL SELECT {FK}, 1000000, 0, bx, by_ FROM t WHERE n >= 2 AND total >= 700 QUALIFY row_number() OVER (PARTITION BY {FK} ORDER BY i DESC) = 1
UNION ALL SELECT {FK}, i, 0, vx, vy FROM lift_line_vertices WHERE ({FK}) NOT IN (SELECT ({FK}) FROM t WHERE n >= 2 AND total >= 700)),
d AS (SELECT *, row_number() OVER w - 1 AS r, lag(vx) OVER w = vx AND lag(vy) OVER w = vy AND i = 1000000 AS twice FROM o WINDOW w AS (PARTITION BY {FK} ORDER BY i, k))
SELECT {FK}, 0 AS part, CAST(r AS INT) AS i, vx, vy FROM d WHERE twice IS NOT TRUE""", LV)(lambda spark, d: _verts(O.resample(lines(spark, d), 700)))  # fmt: skip
query("dash", f"""WITH {MEASURED}, k AS (SELECT *, unnest(range(CAST(floor((at_ + 100 - 300) / 500) AS BIGINT), CAST(floor((at_ + l + 100) / 500) AS BIGINT) + 1)) AS k FROM m WHERE l > 0),
c AS (SELECT *, least(greatest(k * 500 - 100, at_), at_ + l) - at_ AS ta, least(greatest(k * 500 + 200, at_), at_ + l) - at_ AS tb FROM k
  WHERE k * 500 + 300 > at_ + 100 + 0.000000001 AND k * 500 < at_ + l + 100 - 0.000000001),
e AS (SELECT {FK}, k, 2 * i AS o, {ON.format(t="ta / l")} FROM c UNION ALL SELECT {FK}, k, 2 * i + 1, {ON.format(t="tb / l")} FROM c),
u AS (SELECT * FROM (SELECT *, lag(vx) OVER w = vx AND lag(vy) OVER w = vy AS twice FROM e WINDOW w AS (PARTITION BY {FK}, k ORDER BY o)) WHERE twice IS NOT TRUE)
SELECT {FK}, CAST(dense_rank() OVER (PARTITION BY {FK} ORDER BY k) - 1 AS INT) AS part, CAST(row_number() OVER (PARTITION BY {FK}, k ORDER BY o) - 1 AS INT) AS i, vx, vy FROM u""", LV)(
    lambda spark, d: _verts(O.dash(lines(spark, d), 300, 200, 100)))
_SWING = f"sin(k * 25.0 * {2 * math.pi / 200!r}) * 20.0"
query("wave", f"""WITH {MEASURED}, k AS (SELECT *, unnest(range(CAST(ceil(at_ / 25) AS BIGINT), CAST(ceil((at_ + l) / 25) AS BIGINT) + 1)) AS k FROM m WHERE l > 0),
p AS (SELECT {FK}, i, k, CAST(round(ax + (bx - ax) * ((k * 25.0 - at_) / l) - (by_ - ay) / l * ({_SWING})) AS BIGINT) AS vx,
CAST(round(ay + (by_ - ay) * ((k * 25.0 - at_) / l) + (bx - ax) / l * ({_SWING})) AS BIGINT) AS vy FROM k WHERE k * 25.0 < at_ + l),
n AS (SELECT {FK}, count(*) AS n FROM p GROUP BY {FK}) SELECT {FK}, 0 AS part, CAST(row_number() OVER (PARTITION BY {FK} ORDER BY p.i, k) - 1 AS INT) AS i, vx, vy FROM p JOIN n USING ({FK}) WHERE n >= 2""", LV)(
    lambda spark, d: _verts(O.wave(lines(spark, d), 20.0, 200.0)))
query("hatch", f"""WITH k AS (SELECT *, unnest(range(CAST(floor((y0 + y * 4096) / 100.0) AS BIGINT) - 1, CAST(ceil((y1 + y * 4096) / 100.0) AS BIGINT) + 2)) AS k FROM lift_rects), v AS (SELECT *, (k + 0.25) * 100 - y * 4096 AS v FROM k)
SELECT {FK}, CAST(round(v) AS BIGINT) AS yy, CAST(x0 AS BIGINT) AS xa, CAST(x1 AS BIGINT) AS xb FROM v WHERE (y0 > v) <> (y1 > v)""", "lift_rects")(
    lambda spark, d: O.hatch(rects(spark, d), 0.0, 100.0, 0.25).select("z", "x", "y", "feature_ix", F.explode("lines").alias("l")).select("z", "x", "y", "feature_ix", F.col("l")[0]["y"].cast("long").alias("yy"), F.col("l")[0]["x"].cast("long").alias("xa"), F.col("l")[1]["x"].cast("long").alias("xb")))
_T30 = [f"CAST({f(math.radians(30))!r} AS DOUBLE)" for f in (math.cos, math.sin)]
query("hatch_turned", f"""WITH r AS (SELECT *, y * (4096 * {_T30[0]}) - x * (4096 * {_T30[1]}) AS origin FROM lift_rects),
c AS (SELECT {FK}, origin, q, CASE WHEN q IN (0, 3) THEN x0 ELSE x1 END AS cx, CASE WHEN q IN (0, 1) THEN y0 ELSE y1 END AS cy FROM r, (VALUES (0), (1), (2), (3)) AS k(q)),
t AS (SELECT {FK}, origin, q, cx * {_T30[0]} + cy * {_T30[1]} AS u, cy * {_T30[0]} - cx * {_T30[1]} AS v FROM c),
e AS (SELECT a.*, b.u AS u1, b.v AS v1, min(a.v) OVER w AS low, max(a.v) OVER w AS high FROM t AS a JOIN t AS b ON a.feature_ix = b.feature_ix AND b.q = (a.q + 1) % 4 WINDOW w AS (PARTITION BY a.feature_ix)),
k AS (SELECT *, unnest(range(CAST(floor((low + origin) / 80) AS BIGINT), CAST(ceil((high + origin) / 80) AS BIGINT) + 1)) AS k FROM e),
h AS (SELECT {FK}, k, k * 80 - origin AS at_, u + (k * 80 - origin - v) * ((u1 - u) / (v1 - v)) AS hit FROM k WHERE (v > k * 80 - origin) <> (v1 > k * 80 - origin)),
s AS (SELECT *, row_number() OVER w AS n, lead(hit) OVER w AS far FROM h WINDOW w AS (PARTITION BY {FK}, k ORDER BY hit)),
l AS (SELECT {FK}, at_, hit, far, CAST(row_number() OVER (PARTITION BY {FK} ORDER BY k, n) - 1 AS INT) AS part FROM s WHERE n % 2 = 1 AND far > hit)
SELECT {FK}, part, CAST(i AS INT) AS i, CAST(round(CASE WHEN i = 0 THEN hit ELSE far END * {_T30[0]} - at_ * {_T30[1]}) AS BIGINT) AS vx,
CAST(round(CASE WHEN i = 0 THEN hit ELSE far END * {_T30[1]} + at_ * {_T30[0]}) AS BIGINT) AS vy FROM l, (VALUES (0), (1)) AS k2(i)""", "lift_rects")(
    lambda spark, d: _verts(O.hatch(rects(spark, d), 30.0, 80.0)))
_DRAW = lambda k: sql_draw("i + 1", "j + 1", str(k), salt=5)
_LAT = f"degrees(atan((exp((1 - 2 * least(greatest((j + 0.5) * 128 / 16384.0, 0), 1)) * pi()) - exp(-(1 - 2 * least(greatest((j + 0.5) * 128 / 16384.0, 0), 1)) * pi())) / 2))"
query("dot_density", f"""WITH j AS (SELECT *, unnest(range(CAST(floor((y0 + y * 4096) / 128.0) AS BIGINT), CAST(floor((y1 + y * 4096) / 128.0) AS BIGINT) + 1)) AS j FROM lift_rects),
k AS (SELECT *, least(value / 1000000.0 * pow(cos(radians({_LAT})) * {mercator.EARTH_M!r} / 4 / 4096 / 1000, 2) * 16384, 1.0) AS keep FROM j),
i AS (SELECT *, unnest(range(CAST(floor((x0 + x * 4096) / 128.0) AS BIGINT), CAST(floor((x1 + x * 4096) / 128.0) AS BIGINT) + 1)) AS i FROM k WHERE keep > 0),
p AS (SELECT *, (i + 0.5 + ({_DRAW(1)} - 0.5)) * 128 - x * 4096 AS px, (j + 0.5 + ({_DRAW(2)} - 0.5)) * 128 - y * 4096 AS py FROM i WHERE {_DRAW(3)} < keep)
SELECT {FK}, i, j, round(px) AS vx, round(py) AS vy FROM p WHERE px >= x0 AND px < x1 AND py >= y0 AND py < y1""", "lift_rects")(
    lambda spark, d: O.dot_density(rects(spark, d), F.col("value") / 1e6, spacing=128.0, seed=5).select("z", "x", "y", "feature_ix", "i", "j", "vx", "vy"))
_SEGTO = "(SELECT z, x, y, feature_ix, CAST(floor((gx - floor(gx)) * 4096) AS BIGINT) AS vx, CAST(floor((gy - floor(gy)) * 4096) AS BIGINT) AS vy FROM (SELECT *, (lon + 180) / 360 * 16 AS gx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 16 AS gy FROM lift_tiled) AS q)"
query("segment_to", f"""WITH p AS {_SEGTO}, s AS (SELECT *, round(((10.0 + 180) / 360 * 16 - x) * 4096) AS x0, round(((1 - asinh(tan(radians(20.0))) / pi()) / 2 * 16 - y) * 4096) AS y0 FROM p), l AS (SELECT *, sqrt((vx - x0) * (vx - x0) + (vy - y0) * (vy - y0)) AS len FROM s),
e AS (SELECT *, round(x0 + (vx - x0) * ((len - 50) / len)) AS x1, round(y0 + (vy - y0) * ((len - 50) / len)) AS y1 FROM l WHERE len > 50) SELECT z, x, y, feature_ix, {I('x0', 'x0')}, {I('y0', 'y0')}, {I('x1', 'x1')}, {I('y1', 'y1')} FROM e WHERE x1 <> x0 OR y1 <> y0""", "lift_tiled")(
    lambda spark, d: O.segment_to(points(spark, d).withColumn("points", F.array(O.point(F.col("vx"), F.col("vy")))), F.lit(10.0), F.lit(20.0), 50.0).select("z", "x", "y", "feature_ix", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]))
query("buffer_points", f"WITH p AS {_SEGTO} SELECT z, x, y, feature_ix, CAST(i AS INT) AS i, CAST(round(vx + 40 * cos(i * {2 * math.pi / 26!r})) AS BIGINT) AS vx, CAST(round(vy + 40 * sin(i * {2 * math.pi / 26!r})) AS BIGINT) AS vy FROM p, (SELECT unnest(range(26)) AS i) AS k", "lift_tiled")(
    lambda spark, d: _verts(O.buffer_points(points(spark, d).select("z", "x", "y", "feature_ix", F.array(O.point(F.col("vx"), F.col("vy"))).alias("points")), 40.0), "polygons").drop("part", "ring"))
query("junctions", f"""WITH v AS (SELECT *, lead(vx) OVER w AS nx, lead(vy) OVER w AS ny FROM lift_line_vertices WINDOW w AS (PARTITION BY {FK} ORDER BY i)),
s AS (SELECT *, row_number() OVER (PARTITION BY {FK} ORDER BY i) AS f, row_number() OVER (PARTITION BY {FK} ORDER BY i DESC) AS b FROM v WHERE nx IS NOT NULL AND (nx <> vx OR ny <> vy)),
e AS (SELECT z, x, y, vx, vy, degrees(atan2(ny - vy, nx - vx)) AS t FROM s WHERE f = 1 UNION ALL SELECT z, x, y, nx, ny, degrees(atan2(vy - ny, vx - nx)) FROM s WHERE b = 1),
a AS (SELECT z, x, y, vx, vy, count(*) AS arms, sum(cos(radians(t))) AS c, sum(sin(radians(t))) AS sn FROM e GROUP BY z, x, y, vx, vy),
u AS (SELECT DISTINCT z, x, y, vx, vy, (round(t, 3) + 360) % 360 AS t FROM e),
g AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w + 360) - t AS gap, first_value(t) OVER w AS t0 FROM u WINDOW w AS (PARTITION BY z, x, y, vx, vy ORDER BY t)),
k AS (SELECT z, x, y, vx, vy, arms, min(t0) AS t0, min(gap) AS least_gap, max_by(t + gap / 2, gap - t / 100000000) AS middle, any_value(c) AS c, any_value(sn) AS sn,
min(abs((t - degrees(atan2(sn, c)) + 540) % 360 - 180)) AS near FROM g JOIN a USING (z, x, y, vx, vy) GROUP BY z, x, y, vx, vy, arms),
o AS (SELECT *, CASE WHEN arms = 1 OR c * c + sn * sn < 0.000001 THEN t0 + 90 WHEN near < 20 OR least_gap < 40 THEN middle ELSE degrees(atan2(sn, c)) END AS axis FROM k)
SELECT z, x, y, CAST(vx AS BIGINT) AS vx, CAST(vy AS BIGINT) AS vy, arms, CAST(round((axis - 180 * floor(axis / 180)) * 10000) AS BIGINT) % 1800000 AS axis4 FROM o""", LV)(
    lambda spark, d: O.junctions(lines(spark, d)).select("z", "x", "y", F.col("vx").cast("long").alias("vx"), F.col("vy").cast("long").alias("vy"), "arms", (F.round(F.col("axis_deg") * 10000).cast("long") % 1800000).alias("axis4")))
query("junctions_snapped")(lambda spark, d: O.junctions(lines(spark, d), snap=40.0))
_CORNER = "CASE WHEN i IN (0, 3) THEN {0} ELSE {1} END AS vx, CASE WHEN i IN (0, 1) THEN {2} ELSE {3} END AS vy"
_FOUR = "(VALUES (0), (1), (2), (3)) AS k4(i)"
query("stitch", f"""SELECT 2 AS z, CAST(((x - dx) % 4 + 4) % 4 AS INT) AS x, CAST(y - dy AS INT) AS y, feature_ix, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, CAST(i AS INT) AS i,
{_CORNER.format(*(f"CAST({c} + d{c[0]} * 4096 AS BIGINT)" for c in ("x0", "x1", "y0", "y1")))}
FROM lift_rects, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy), {_FOUR} WHERE y - dy BETWEEN 0 AND 3""", "lift_rects")(
    lambda spark, d: O.vertices(O.stitched(rects(spark, d)), "polygons").select("z", "x", "y", "feature_ix", "dx", "dy", "i", *[F.col(c).cast("long").alias(c) for c in ("vx", "vy")]))
query("cull", f"SELECT {FK} FROM lift_rects WHERE x1 >= -10 AND x0 <= 4096 + 10 AND y1 >= -10 AND y0 <= 4106", "lift_rects")(lambda spark, d: O.culled(rects(spark, d), 10).select("z", "x", "y", "feature_ix"))
_ZOOMED = """FROM lift_rects, (VALUES (0), (1)) AS a(ti), (VALUES (0), (1)) AS b(tj)
WHERE ti BETWEEN floor(x0 * 2 / 4096.0) AND floor(x1 * 2 / 4096.0) AND tj BETWEEN floor(y0 * 2 / 4096.0) AND floor(y1 * 2 / 4096.0)"""
query("overzoom", f"""WITH q AS (SELECT 3 AS z, CAST(x * 2 + ti AS INT) AS x, CAST(y * 2 + tj AS INT) AS y, feature_ix, x0 * 2 - ti * 4096 AS x0, x1 * 2 - ti * 4096 AS x1, y0 * 2 - tj * 4096 AS y0, y1 * 2 - tj * 4096 AS y1 {_ZOOMED})
SELECT {FK}, CAST(i AS INT) AS i, {_CORNER.format(*(f"CAST({c} AS BIGINT)" for c in ("x0", "x1", "y0", "y1")))} FROM q, {_FOUR}""", "lift_rects")(
    lambda spark, d: _verts(O.overzoomed(rects(spark, d), 3), "polygons").drop("part", "ring"))
query("overzoom_clip", f"""WITH q AS (SELECT 3 AS z, CAST(x * 2 + ti AS INT) AS x, CAST(y * 2 + tj AS INT) AS y, feature_ix, greatest(x0 * 2 - ti * 4096, -64) AS x0, least(x1 * 2 - ti * 4096, 4160) AS x1,
greatest(y0 * 2 - tj * 4096, -64) AS y0, least(y1 * 2 - tj * 4096, 4160) AS y1 {_ZOOMED})
SELECT {FK}, {_CORNER.format(*(f"CAST({c} AS BIGINT)" for c in ("x0", "x1", "y0", "y1")))} FROM q, {_FOUR} WHERE x1 > x0 AND y1 > y0""", "lift_rects")(
    lambda spark, d: _verts(clipping.overzoom(rects(spark, d), 3, 64.0), "polygons").drop("part", "ring", "i"))
query("clip_polygons", f"""WITH q AS (SELECT {FK}, greatest(x0, 1000) AS x0, least(x1, 3000) AS x1, greatest(y0, 500) AS y0, least(y1, 2500) AS y1 FROM lift_rects)
SELECT {FK}, {_CORNER.format(*(f"CAST({c} AS BIGINT)" for c in ("x0", "x1", "y0", "y1")))} FROM q, {_FOUR} WHERE x1 > x0 AND y1 > y0""", "lift_rects")(
    lambda spark, d: _verts(clipping.clip(rects(spark, d), 1000, 500, 3000, 2500), "polygons").drop("part", "ring", "i"))
query("clip_lines", f"""WITH {SEG}, h AS (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM g),
t AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN (1000 - ax) / CAST(dx AS DOUBLE) WHEN dx < 0 THEN (3000 - ax) / CAST(dx AS DOUBLE) ELSE 0 END, CASE WHEN dy > 0 THEN (500 - ay) / CAST(dy AS DOUBLE) WHEN dy < 0 THEN (2500 - ay) / CAST(dy AS DOUBLE) ELSE 0 END) AS t0,
least(1.0, CASE WHEN dx > 0 THEN (3000 - ax) / CAST(dx AS DOUBLE) WHEN dx < 0 THEN (1000 - ax) / CAST(dx AS DOUBLE) ELSE 1 END, CASE WHEN dy > 0 THEN (2500 - ay) / CAST(dy AS DOUBLE) WHEN dy < 0 THEN (500 - ay) / CAST(dy AS DOUBLE) ELSE 1 END) AS t1
FROM h WHERE (dx <> 0 OR ax BETWEEN 1000 AND 3000) AND (dy <> 0 OR ay BETWEEN 500 AND 2500)),
o AS (SELECT {FK}, CAST(round(ax + dx * t0) AS BIGINT) AS x0, CAST(round(ay + dy * t0) AS BIGINT) AS y0, CAST(round(ax + dx * t1) AS BIGINT) AS x1, CAST(round(ay + dy * t1) AS BIGINT) AS y1 FROM t WHERE t0 <= t1)
SELECT {FK}, x0, y0, x1, y1 FROM o WHERE x0 <> x1 OR y0 <> y1""", LV)(
    lambda spark, d: _pieces(clipping.clip(lines(spark, d), 1000, 500, 3000, 2500)))


def _pieces(df):
    """Lines as their segments."""
    rows = df.select("z", "x", "y", "feature_ix", F.explode("lines").alias("l")).select("z", "x", "y", "feature_ix", F.explode(O._segments(F.col("l"), False)).alias("s"))
    return rows.select("z", "x", "y", "feature_ix", *[F.col(f"s.{e}.{k}").cast("long").alias(f"{k}{i}") for i, e in enumerate("ab") for k in "xy"])


def tiles(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.lit(3).alias("z"), (F.col("n_nationkey") % 8).cast("int").alias("x"), F.col("n_regionkey").cast("int").alias("y")).distinct()


_T = "tiles AS (SELECT DISTINCT 3 AS z, CAST(n_nationkey % 8 AS INT) AS x, CAST(n_regionkey AS INT) AS y FROM nation)"
query("tile_bounds", f"WITH {_T} SELECT z, x, y, CAST(i AS INT) AS i, CAST(CASE WHEN i IN (0, 3) THEN -64 ELSE 4160 END AS BIGINT) AS vx, CAST(CASE WHEN i IN (0, 1) THEN -64 ELSE 4160 END AS BIGINT) AS vy FROM tiles, (VALUES (0), (1), (2), (3)) AS k(i)")(
    lambda spark, d: _verts(O.tile_bounds(tiles(spark, d), "canvas", 8), "polygons").select("z", "x", "y", "i", "vx", "vy"))
query("point_grid", f"WITH {_T}, j AS (SELECT *, unnest(range(CAST(ceil(y * 4096 / 300.0) AS BIGINT), CAST(ceil((y + 1) * 4096 / 300.0) AS BIGINT))) AS j FROM tiles), i AS (SELECT *, unnest(range(CAST(ceil((x * 4096 - (j % 2) * 250.0) / 500.0) AS BIGINT), CAST(ceil(((x + 1) * 4096 - (j % 2) * 250.0) / 500.0) AS BIGINT))) AS i FROM j) SELECT z, x, y, i, j, CAST(round(i * 500.0 + (j % 2) * 250.0 - x * 4096) AS BIGINT) AS vx, CAST(round(j * 300.0 - y * 4096) AS BIGINT) AS vy FROM i")(
    lambda spark, d: O.point_grid(tiles(spark, d), 500.0, 300.0, 0.5).select("z", "x", "y", "i", "j", F.col("vx").cast("long").alias("vx"), F.col("vy").cast("long").alias("vy")))
_SCATTER = lambda k: sql_draw("i + 1", "j + 1", k, salt=9)
query("point_scatter", f"""WITH {_T}, j AS (SELECT *, unnest(range(CAST(floor(y * 4096 / 400.0) AS BIGINT), CAST(floor(((y + 1) * 4096 - 0.000000001) / 400.0) AS BIGINT) + 1)) AS j FROM tiles),
i AS (SELECT *, unnest(range(CAST(floor(x * 4096 / 400.0) AS BIGINT), CAST(floor(((x + 1) * 4096 - 0.000000001) / 400.0) AS BIGINT) + 1)) AS i FROM j),
n AS (SELECT *, {_SCATTER('0')} * 16 AS u FROM i), k AS (SELECT *, unnest(range(1, CASE WHEN u < 6 THEN 1 WHEN u < 12 THEN 2 WHEN u < 14 THEN 3 ELSE 4 END)) AS k FROM n),
p AS (SELECT z, x, y, i, j, CAST(k AS INT) AS k, round((i + {_SCATTER('k * 2 + 1')}) * 400 - x * 4096) AS vx, round((j + {_SCATTER('k * 2 + 2')}) * 400 - y * 4096) AS vy FROM k)
SELECT * FROM p WHERE vx BETWEEN 0 AND 4095 AND vy BETWEEN 0 AND 4095""")(lambda spark, d: O.point_scatter(tiles(spark, d), 400.0, seed=9))  # fmt: skip
_DEG = "degrees(atan((exp((1 - 2 * ({0})) * pi()) - exp(-(1 - 2 * ({0})) * pi())) / 2))"
query("graticule", f"""WITH {_T}, b AS (SELECT *, x / 8.0 * 360 - 180 AS west, (x + 1) / 8.0 * 360 - 180 AS east, {_DEG.format("(y + 1) / 8.0")} AS south, {_DEG.format("y / 8.0")} AS north FROM tiles),
k AS (SELECT z, x, y, 'meridian' AS axis, unnest(range(CAST(ceil(round(west / 10, 9)) AS BIGINT), CAST(floor(round(east / 10, 9)) AS BIGINT) + 1)) * 10.0 AS degrees FROM b
UNION ALL SELECT z, x, y, 'parallel', unnest(range(CAST(ceil(round(south / 10, 9)) AS BIGINT), CAST(floor(round(north / 10, 9)) AS BIGINT) + 1)) * 10.0 FROM b),
m AS (SELECT *, round(((degrees + 180) / 360 * 8 - x) * 4096) AS mx, round(((1 - asinh(tan(radians(least(greatest(degrees, -{mercator.MAX_LATITUDE}), {mercator.MAX_LATITUDE})))) / pi()) / 2 * 8 - y) * 4096) AS my FROM k)
SELECT z, x, y, axis, CAST(degrees AS BIGINT) AS degrees, CAST(CAST(abs(degrees) AS BIGINT) AS VARCHAR) || '°' || CASE WHEN degrees = 0 THEN '' WHEN axis = 'meridian' THEN CASE WHEN degrees > 0 THEN 'E' ELSE 'W' END WHEN degrees > 0 THEN 'N' ELSE 'S' END AS label,
{', '.join(f"CAST(CASE WHEN axis = 'meridian' THEN {e} ELSE {p} END AS BIGINT) AS {n}" for n, e, p in (("x0", "mx", "0"), ("y0", "0", "my"), ("x1", "mx", "4096"), ("y1", "4096", "my")))} FROM m""")(
    lambda spark, d: O.graticule(tiles(spark, d), O.graticule_step(3), O.graticule_step(3)).select("z", "x", "y", "axis", "label", *[F.col(c).cast("long").alias(c) for c in ("degrees", "x0", "y0", "x1", "y1")]))
query("literal_geometry", "SELECT 0 AS z, 0 AS x, 0 AS y, CAST(0 AS BIGINT) AS feature_ix, CAST(p AS INT) AS part, CAST(i AS INT) AS i, CAST(vx AS BIGINT) AS vx, CAST(vy AS BIGINT) AS vy FROM (VALUES (0, 0, 0, 0), (0, 1, 10, 0), (0, 2, 10, 10), (1, 0, -5, 7), (1, 1, 6, 8)) AS t(p, i, vx, vy)")(
    lambda spark, d: _verts(O.literal_geometry(spark, lines=[[(0, 0), (10, 0), (10, 10)], [(-5, 7), (6, 8)]])))

_E = {"kind": "CASE WHEN kind IN ('click', 'purchase') THEN 2.0 WHEN kind = 'view' THEN 1.0 ELSE 0.5 END", "size": "CASE WHEN value >= 100 THEN 10.0 WHEN value >= 0 THEN 2 + (10 - 2) * (value - 0) / 100 ELSE 2.0 END", "band": "CASE WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'mid' ELSE 'low' END"}
query("expressions", f"SELECT feature_ix, CAST(round(({_E['kind']}) * ({_E['size']}) * 1000000) AS BIGINT) AS size6, {_E['band']} AS band, upper(concat(kind, '-', substr(kind, 2, 2))) AS label FROM lift_tiled WHERE value > 5 AND NOT (kind = 'error')", "lift_tiled")(
    lambda spark, d: _expressions(lifted(spark, d, "lift_tiled")))


def _expressions(f):
    on = lambda e: compile_expression(e, f.columns)
    size = ["*", ["match", ["get", "kind"], ["click", "purchase"], 2, "view", 1, 0.5], ["interpolate", ["linear"], ["get", "value"], 0, 2, 100, 10]]
    keep = f.where(compile_filter(["all", [">", ["get", "value"], 5], ["!", ["==", ["get", "kind"], "error"]]], f.columns))
    return keep.select("feature_ix", micro(on(size)).alias("size6"), on(["step", ["get", "value"], "low", 10, "mid", 50, "high"]).alias("band"), on(["upcase", ["concat", ["get", "kind"], "-", ["slice", ["get", "kind"], 1, 3]]]).alias("label"))


query("features_scan", "SELECT z, x, y, feature_ix, kind FROM lift_tiled WHERE kind IN ('view', 'click') AND value <= z * 10", "lift_tiled")(
    lambda spark, d: O.features(lifted(spark, d, "lift_tiled"), where=F.col("kind").isin("view", "click"), min_zoom=2, max_zoom=6).where("value <= z * 10").select("z", "x", "y", "feature_ix", "kind"))
query("tile_pyramid", "WITH k AS (SELECT unnest(range(5)) AS s) SELECT CAST(4 - s AS INT) AS z, CAST(floor(x / pow(2, s)) AS INT) AS x, CAST(floor(y / pow(2, s)) AS INT) AS y, count(*) AS n FROM lift_tiled, k GROUP BY 1, 2, 3", "lift_tiled")(
    lambda spark, d: lifted(spark, d, "lift_tiled").groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4)))).groupBy((F.col("z") - F.col("s")).cast("int").alias("z"), F.floor(F.col("x") / F.pow(F.lit(2), "s")).cast("int").alias("x"), F.floor(F.col("y") / F.pow(F.lit(2), "s")).cast("int").alias("y")).agg(F.sum("n").alias("n")))
query("frame_features", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY y, x, feature_ix) AS n FROM lift_rects WHERE x1 >= 100 AND x0 <= 2000 AND y1 >= 100 AND y0 <= 2000) SELECT kind, z, x, y, feature_ix FROM r WHERE n = 1", "lift_rects")(
    lambda spark, d: labels.frame_features(lifted(spark, d, "lift_rects"), ["kind"], (100, 100, 2000, 2000)).select("kind", "z", "x", "y", "feature_ix"))


def candidates(spark, d):
    return lifted(spark, d, "lift_candidates").withColumn("layer_ix", (F.col("cand_ix") % 2).cast("int"))


query("label_identical_once", "SELECT z, x, y, cand_ix FROM (SELECT *, row_number() OVER (PARTITION BY z, x, y, text, wax, way ORDER BY cand_ix % 2 DESC, sort_key, cand_ix) AS n FROM lift_candidates) AS q WHERE n = 1", "lift_candidates")(
    lambda spark, d: labels.identical_once(candidates(spark, d)).select("z", "x", "y", "cand_ix"))
query("label_placement")(lambda spark, d: labels.label_placement(candidates(spark, d), 500.0))
query("label_boxes")(lambda spark, d: labels.label_boxes(candidates(spark, d), labels.label_placement(candidates(spark, d)), "all"))
query("text_draw")(lambda spark, d: labels.text_draw(candidates(spark, d), labels.label_placement(candidates(spark, d)), 1).select("z", "x", "y", "cand_ix", "text"))
query("convex_hull")(lambda spark, d: kernels.convex_hull(lifted(spark, d, LV)))
query("simplify")(lambda spark, d: _verts(kernels.simplify(lines(spark, d), 200.0)))
_sites = lambda spark, d: lifted(spark, d, "lift_candidates").select("z", "x", "y", F.col("wax").alias("vx"), F.col("way").alias("vy"))
query("triangulate")(lambda spark, d: kernels.triangulate(_sites(spark, d)))
query("voronoi")(lambda spark, d: kernels.voronoi(_sites(spark, d)))
query("nearest_seed", f"""WITH p AS {_SEGTO}, s AS (SELECT z, x, y, sx, sy, min(seed_ix) AS seed_ix FROM lift_seeds GROUP BY ALL),
q AS (SELECT p.*, seed_ix, row_number() OVER (PARTITION BY feature_ix ORDER BY pow(sx - vx, 2) + pow((sy - vy) * 2.0, 2), seed_ix) AS n FROM p JOIN s USING (z, x, y))
SELECT z, x, y, feature_ix, seed_ix FROM q WHERE n = 1""", "lift_tiled", "lift_seeds")(
    lambda spark, d: O.nearest_seed(points(spark, d).select("z", "x", "y", "feature_ix", "vx", "vy"), lifted(spark, d, "lift_seeds"), 2.0).select("z", "x", "y", "feature_ix", "seed_ix"))
