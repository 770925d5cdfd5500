"""Features, fields, pixels and label candidates out of the business tables, by whole-number SQL that any engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid, tasks

SQL = {
    "lift_points": """SELECT event_id AS feature_ix, event_type AS kind, value, ts, user_id,
  (user_id * 7919 + event_id * 104729) % 36000 / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
  (user_id * 15485 + event_id * 32452843) % 16000 / CAST(100 AS DOUBLE) - CAST(80 AS DOUBLE) AS lat FROM events""",
    "lift_tiled": """SELECT feature_ix, kind, value, lon, lat, 4 AS z,
  CAST(floor((lon + 180) / 360 * 16) AS INT) AS x,
  CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16) AS INT) AS y FROM lift_points""",
    "lift_rects": """SELECT o_orderkey AS feature_ix, o_orderpriority AS kind, o_totalprice AS value, 2 AS z, CAST(o_custkey % 4 AS INT) AS x, CAST(o_orderkey % 4 AS INT) AS y,
  (o_orderkey * 7919) % 3800 AS x0, (o_custkey * 104729) % 3800 AS y0,
  (o_orderkey * 7919) % 3800 + 16 + o_orderkey % 200 AS x1, (o_custkey * 104729) % 3800 + 16 + o_custkey % 200 AS y1 FROM orders""",
    "lift_line_vertices": """SELECT user_id AS feature_ix, 2 AS z, CAST(user_id % 4 AS INT) AS x, CAST(floor(user_id / CAST(4 AS DOUBLE)) AS INT) % 4 AS y,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i,
  (event_id * 7919 + user_id * 31) % 4096 AS vx, (event_id * 104729 + user_id * 17) % 4096 AS vy FROM events""",
    "lift_field": """SELECT 12 AS z, CAST(floor(l_orderkey / CAST(512 AS DOUBLE)) AS INT) % 64 AS x, CAST(floor(l_orderkey / CAST(32768 AS DOUBLE)) AS INT) AS y, CAST(l_orderkey % 32 AS INT) AS px, CAST(l_partkey % 32 AS INT) AS py,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "lift_pixels": """SELECT z, x, y, px, py, CAST(floor(r * a / CAST(255 AS DOUBLE)) AS INT) AS r, CAST(floor(g * a / CAST(255 AS DOUBLE)) AS INT) AS g, CAST(floor(b * a / CAST(255 AS DOUBLE)) AS INT) AS b, a FROM (
  SELECT 12 AS z, CAST(floor(l_orderkey / CAST(512 AS DOUBLE)) AS INT) % 64 AS x, CAST(floor(l_orderkey / CAST(32768 AS DOUBLE)) AS INT) AS y, CAST(l_orderkey % 32 AS INT) AS px, CAST(l_partkey % 32 AS INT) AS py,
  CAST(sum(l_orderkey * 37) % 256 AS INT) AS r, CAST(sum(l_partkey * 53) % 256 AS INT) AS g, CAST(sum(l_orderkey * 11 + l_partkey) % 256 AS INT) AS b, CAST(255 - sum(l_linenumber) % 3 * 100 AS INT) AS a
  FROM lineitem GROUP BY 1, 2, 3, 4, 5) AS raw""",
    "lift_overlay": """SELECT z, x, y, px, py, CAST(floor(r * a / CAST(255 AS DOUBLE)) AS INT) AS r, CAST(floor(g * a / CAST(255 AS DOUBLE)) AS INT) AS g, CAST(floor(b * a / CAST(255 AS DOUBLE)) AS INT) AS b, a FROM (
  SELECT 12 AS z, CAST(floor(o_orderkey / CAST(512 AS DOUBLE)) AS INT) % 64 AS x, CAST(floor(o_orderkey / CAST(32768 AS DOUBLE)) AS INT) AS y, CAST(o_orderkey % 32 AS INT) AS px, CAST(floor(o_orderkey / CAST(32 AS DOUBLE)) AS INT) % 32 AS py,
  CAST(sum(o_custkey * 41) % 256 AS INT) AS r, CAST(sum(o_orderkey * 13) % 256 AS INT) AS g, CAST(sum(o_custkey * 7 + o_orderkey) % 256 AS INT) AS b, CAST(255 - count(*) % 4 * 60 AS INT) AS a
  FROM orders GROUP BY 1, 2, 3, 4, 5) AS raw""",
    "lift_seeds": """SELECT c_custkey AS seed_ix, 4 AS z, CAST(floor(gx) AS INT) AS x, CAST(floor(gy) AS INT) AS y,
  CAST(floor((gx - floor(gx)) * 4096) AS BIGINT) AS sx, CAST(floor((gy - floor(gy)) * 4096) AS BIGINT) AS sy
  FROM (SELECT c_custkey, (c_custkey * 7919) % 36000 / CAST(2250 AS DOUBLE) AS gx, 3 + (c_custkey * 15485) % 10000 / CAST(1000 AS DOUBLE) AS gy FROM customer) AS g""",
    "lift_candidates": """SELECT p_partkey AS cand_ix, p_name AS text, p_size AS sort_key, 2 AS z, CAST(p_partkey % 4 AS INT) AS x, CAST(p_size % 4 AS INT) AS y, (p_partkey * 7919) % 4096 AS wax, (p_partkey * 104729) % 4096 AS way,
  4 * length(p_name) AS half_w, 8 AS half_h FROM part""",
}
#: Fields and rasters have a tile for each 512 orders, so that the number of tiles grows with the tables.
READS = {"lift_points": "events", "lift_tiled": "events", "lift_rects": "orders", "lift_line_vertices": "events", "lift_field": "lineitem", "lift_pixels": "lineitem", "lift_overlay": "orders", "lift_candidates": "part", "lift_seeds": "customer"}
SIZE = 32


_X, _Y = "CAST(floor({k} / CAST(512 AS DOUBLE)) AS INT) % 64", "CAST(floor({k} / CAST(32768 AS DOUBLE)) AS INT)"
_LINES = [e.format(k="l_orderkey") for e in (_X, _Y, "CAST({k} % 32 AS INT)")] + ["CAST(l_partkey % 32 AS INT)"]
#: x, y, px, py of ``SQL``, of lifts that sum by pixel.
SUMMED = {"lift_field": _LINES, "lift_pixels": _LINES, "lift_overlay": [e.format(k="o_orderkey") for e in (_X, _Y, "CAST({k} % 32 AS INT)", "CAST(floor({k} / CAST(32 AS DOUBLE)) AS INT) % 32")]}


def lifted(spark: SparkSession, sf_dir: str, name: str, by_pixel: bool = False) -> DataFrame:
    """One of the lifts over the tables in ``sf_dir``.

    Rows that are summed by pixel are dealt out first: nearly each is a pixel of its own, so that sums of a whole split would hold
    it all. By tile, as what looks at neighbours needs them, or ``by_pixel``, as joins by pixel do.
    """
    rows = spark.read.parquet(f"{sf_dir}/{READS[name]}.parquet")
    if name in SUMMED:
        rows = rows.repartition(tasks(rows), *map(F.expr, SUMMED[name][: 4 if by_pixel else 2]))
    rows.createOrReplaceTempView("lift_source")
    sql = SQL[name]
    if name == "lift_tiled":
        sql = sql.replace("FROM lift_points", f"FROM ({SQL['lift_points']})")
    return spark.sql(sql.replace(f"FROM {READS[name]}", "FROM lift_source"))


def field(spark: SparkSession, sf_dir: str, by_pixel: bool = False) -> Grid:
    return Grid(lifted(spark, sf_dir, "lift_field", by_pixel), SIZE, SIZE, 30.0)


def pixels(spark: SparkSession, sf_dir: str, name: str = "lift_pixels", by_pixel: bool = False) -> Grid:
    return Grid(lifted(spark, sf_dir, name, by_pixel), SIZE, SIZE)


def with_lifts(sql: str, *names: str) -> str:
    """A query with the lifts it names as common table expressions: what a checker runs on the same tables."""
    need = list(dict.fromkeys(n for name in names for n in (("lift_points", name) if name == "lift_tiled" else (name,))))
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in need) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
