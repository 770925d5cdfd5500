"""Queries of GeoJSON, tile enumeration, frames, missing tiles, margins and pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mercator import EARTH_M
from ..operators import geometry
from ..operators.grid import Grid, tasks
from ..sources import geojson
from ..sources import tiles as T
from ..sources.lift import SIZE, field, pixels
from .registry import KEY, V6, query, v6

#: A collection for each customer: a point, a triangle that is closed, a line; text that both engines make alike.
_LON, _LAT = "((c_custkey * 7919) % 3500 - 1750)", "((c_custkey * 15485) % 1600 - 800)"
_P = lambda dx, dy: f"'[' || CAST(({_LON} + {dx}) / CAST(10 AS DOUBLE) AS STRING) || ',' || CAST(({_LAT} + {dy}) / CAST(10 AS DOUBLE) AS STRING) || ']'"
_RING = " || ',' || ".join(_P(dx, dy) for dx, dy in ((0, 0), (30, 0), (30, 20), (0, 0)))
TEXT = f"""SELECT '{{"type":"FeatureCollection","features":[{{"type":"Feature","id":' || CAST(c_custkey AS STRING) || ',"properties":{{"name":"' || c_name || '","size":' || CAST(c_custkey % 7 AS STRING) || ',"list":[1],"none":null}},"geometry":{{"type":"Point","coordinates":' || {_P(0, 0)} ||
'}}}},{{"type":"Feature","id":"x","properties":null,"geometry":{{"type":"GeometryCollection","geometries":[{{"type":"Polygon","coordinates":[[' || {_RING} || ']]}},{{"type":"LineString","coordinates":[' || {_P(0, 0)} || ',' || {_P(25, -15)} || ']}}]}}}}]}}' AS json, c_custkey FROM customer"""


def collections(spark, d):
    """Customers are dealt out before their texts are written: few bytes are much work."""
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    customers.repartition(tasks(customers), "c_custkey").createOrReplaceTempView("geojson_customer")
    return spark.sql(TEXT.replace("FROM customer", "FROM geojson_customer"))


#: Vertices in degrees, written from the same numbers without any text.
_V = f"""v AS (SELECT c_custkey, feature_ix, of_, part, i, ({_LON} + dx) / CAST(10 AS DOUBLE) AS lon, ({_LAT} + dy) / CAST(10 AS DOUBLE) AS lat FROM customer,
(VALUES (0, 'points', 0, 0, 0, 0), (1, 'polygons', 0, 0, 0, 0), (1, 'polygons', 0, 1, 30, 0), (1, 'polygons', 0, 2, 30, 20), (1, 'lines', 0, 0, 0, 0), (1, 'lines', 0, 1, 25, -15)) AS t(feature_ix, of_, part, i, dx, dy))"""


def _long(df, *keys):
    return geometry.every_vertex(df.select(*keys, "feature_ix", *geometry.SHAPES))


query("geojson_decode", f"WITH {_V} SELECT c_custkey, CAST(feature_ix AS BIGINT) AS feature_ix, of_, part, i, CAST(round(lon * 10) AS BIGINT) AS vx, CAST(round(lat * 10) AS BIGINT) AS vy FROM v")(
    lambda spark, d: _long(geojson.decode(collections(spark, d)), "c_custkey").withColumns({c: F.round(F.col(c) * 10).cast("long") for c in ("vx", "vy")}))
query("geojson_properties", """SELECT c_custkey, CAST(feature_ix AS BIGINT) AS feature_ix, CASE WHEN feature_ix = 0 THEN c_custkey END AS id, CASE WHEN feature_ix = 0 THEN c_name END AS name, CASE WHEN feature_ix = 0 THEN CAST(c_custkey % 7 AS BIGINT) END AS size,
CAST(NULL AS VARCHAR) AS list, feature_ix = 0 AS has_none, FALSE AS has_more FROM customer, (VALUES (0), (1)) AS t(feature_ix)""")(
    lambda spark, d: _properties(geojson.decode(collections(spark, d))))


def _properties(df):
    from ..functions.expressions import compile_expression

    has = lambda n: F.coalesce(compile_expression(["has", n], df.columns), F.lit(False))
    return df.select("c_custkey", "feature_ix", "id", geojson.prop("name").alias("name"), geojson.prop("size", "bigint").alias("size"), geojson.prop("list").alias("list"), has("none").alias("has_none"), has("more").alias("has_more"))


_W = "0.5 - ln((1 + least(greatest(sin(radians(lat)), -0.999999), 0.999999)) / (1 - least(greatest(sin(radians(lat)), -0.999999), 0.999999))) / (4 * pi())"
query("geojson_tiled", f"""WITH {_V}, w AS (SELECT *, (lon + 180) / 360 AS wx, {_W} AS wy FROM v),
b AS (SELECT c_custkey, feature_ix, greatest(floor(min(wx) * 16 - 64 / 4096.0), 0) AS x0, least(floor(max(wx) * 16 + 64 / 4096.0), 15) AS x1, greatest(floor(min(wy) * 16 - 64 / 4096.0), 0) AS y0, least(floor(max(wy) * 16 + 64 / 4096.0), 15) AS y1 FROM w GROUP BY ALL),
x AS (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT) + 1)) AS x FROM b), t AS (SELECT *, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT) + 1)) AS y FROM x)
SELECT 4 AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, c_custkey, CAST(feature_ix AS BIGINT) AS feature_ix, of_, part, i, CAST(round((wx * 16 - x) * 4096) AS BIGINT) AS vx, CAST(round((wy * 16 - y) * 4096) AS BIGINT) AS vy FROM w JOIN t USING (c_custkey, feature_ix)""")(
    lambda spark, d: _long(geojson.tiled(geojson.decode(collections(spark, d)), 4), "z", "x", "y", "c_custkey").withColumns({c: F.col(c).cast("long") for c in ("vx", "vy")}))

BOX = (-10.0, 35.0, 30.0, 60.0)
_COLUMN = lambda lon: f"CAST(floor(({lon} + 180) / 360 * pow(2, z)) AS BIGINT)"
_ROW = lambda lat: f"CAST(floor((1 - asinh(tan(radians({lat}))) / pi()) / 2 * pow(2, z)) AS BIGINT)"
query("enumerate_tiles", f"""WITH z AS (SELECT CAST(unnest(range(0, 8)) AS INT) AS z), x AS (SELECT *, unnest(range({_COLUMN(BOX[0])}, {_COLUMN(BOX[2])} + 1)) AS x FROM z)
SELECT z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT z, x, unnest(range({_ROW(BOX[3])}, {_ROW(BOX[1])} + 1)) AS y FROM x)""")(lambda spark, d: T.enumerate_tiles(spark, 0, 7, BOX))  # fmt: skip

_EXACT = f"{EARTH_M!r} * cos(radians(48.2)) / pow(2, z) / (25000 * 0.0254 / 150)"
query("frame_layout", f"""WITH z AS (SELECT z, CAST(round({_EXACT}) AS BIGINT) AS size FROM (SELECT unnest(range(0, 25)) AS z) ORDER BY abs(ln({_EXACT} / 512)), z LIMIT 1),
c AS (SELECT z, size, CAST(round((16.37 + 180) / 360 * size * pow(2, z) - 600) AS BIGINT) AS left_, CAST(round((1 - asinh(tan(radians(48.2))) / pi()) / 2 * size * pow(2, z) - 400) AS BIGINT) AS top_ FROM z),
x AS (SELECT *, unnest(range(left_ // size, (left_ + 1200 + size - 1) // size)) AS x FROM c), y AS (SELECT *, unnest(range(top_ // size, (top_ + 800 + size - 1) // size)) AS y FROM x)
SELECT CAST(z AS INT) AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, x * size - left_ AS dx, y * size - top_ AS dy FROM y""")(
    lambda spark, d: T.frame(16.37, 48.2, 25_000, 150, 1200, 800).placed(spark))


def _wanted(spark, d):
    """Tiles one zoom below those of the field, for its first and third column: some of them lie beside it."""
    t = field(spark, d).df.select("z", "x", "y").distinct()
    return t.select((F.col("z") + 1).alias("z"), (F.col("x") * 2 + F.col("x") % 2).alias("x"), (F.col("y") * 2 + 1).alias("y"))


query("on_missing_overzoom", f"""WITH w AS (SELECT DISTINCT z + 1 AS z, x * 2 + x % 2 AS x, y * 2 + 1 AS y FROM lift_field), p AS (SELECT CAST(unnest(range(32)) AS INT) AS p),
q AS (SELECT w.*, a.p AS px, b.p AS py FROM w, p AS a, p AS b)
SELECT q.z, q.x, q.y, q.px, q.py, CAST(round(f.v * 1000000) AS BIGINT) AS v6 FROM q JOIN lift_field AS f ON f.x = q.x // 2 AND f.y = q.y // 2 AND f.px = (q.x % 2 * 32 + q.px) // 2 AND f.py = (q.y % 2 * 32 + q.py) // 2""", "lift_field")(
    lambda spark, d: v6(T.on_missing(_wanted(spark, d), field(spark, d)).df))
query("stitch_window", f"""WITH own AS (SELECT DISTINCT z, x, y FROM lift_field),
m AS (SELECT f.z, (f.x + dx + 4096) % 4096 AS x, f.y + dy AS y, f.px - dx * 32 + 4 AS px, f.py - dy * 32 + 4 AS py, v FROM lift_field AS f, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)
WHERE f.px - dx * 32 BETWEEN -4 AND 35 AND f.py - dy * 32 BETWEEN -4 AND 35) SELECT {KEY}, {V6} FROM m JOIN own USING (z, x, y)""", "lift_field")(
    lambda spark, d: v6(T.stitch_window(field(spark, d), 4).df))
query("stitch_rasters", f"""WITH own AS (SELECT DISTINCT z, x, y FROM lift_pixels),
m AS (SELECT f.z, (f.x + dx + 4096) % 4096 AS x, f.y + dy AS y, f.px - dx * 32 + 2 AS px, f.py - dy * 32 + 2 AS py, r, g, b, a FROM lift_pixels AS f, (VALUES (-1), (0), (1)) AS u(dx), (VALUES (-1), (0), (1)) AS v(dy)
WHERE f.px - dx * 32 BETWEEN -2 AND 33 AND f.py - dy * 32 BETWEEN -2 AND 33) SELECT {KEY}, r, g, b, a FROM m JOIN own USING (z, x, y)""", "lift_pixels")(
    lambda spark, d: T.stitch_window(pixels(spark, d), 2).df)
_FINE = lambda f: f"least(greatest(({f} + 0.5) / 3 - 0.5, 0), 31)"
query("upsample", f"""WITH u AS (SELECT *, unnest(range(greatest((px - 1) * 3, 0), least((px + 2) * 3, 96))) AS fx FROM lift_field), w AS (SELECT *, unnest(range(greatest((py - 1) * 3, 0), least((py + 2) * 3, 96))) AS fy FROM u),
k AS (SELECT *, greatest(1 - abs({_FINE('fx')} - px), 0) * greatest(1 - abs({_FINE('fy')} - py), 0) AS w FROM w)
SELECT z, x, y, CAST(fx AS INT) AS px, CAST(fy AS INT) AS py, CAST(round(sum(v * w) / sum(w) * 1000000) AS BIGINT) AS v6 FROM k WHERE w > 0 GROUP BY ALL""", "lift_field")(
    lambda spark, d: v6(T.upsample(field(spark, d), 3).df))


def _page(spark, d):
    grid: Grid = field(spark, d)
    page = T.Frame(12, SIZE, 1.0, 100, 60, 20, 10)
    return page.pixels(grid).select("fx", "fy", F.round(F.col("v") * 1_000_000).cast("long").alias("v6"))


query("frame_pixels", "SELECT * FROM (SELECT CAST(x AS BIGINT) * 32 + px - 20 AS fx, CAST(y AS BIGINT) * 32 + py - 10 AS fy, CAST(round(v * 1000000) AS BIGINT) AS v6 FROM lift_field) AS p WHERE fx BETWEEN 0 AND 99 AND fy BETWEEN 0 AND 59", "lift_field")(_page)
