"""Where queries register themselves with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lift import with_lifts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *lifts: str):
    """Register ``f(spark, sf_dir)``; ``sql`` may read the ``lifts`` it names."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_lifts(sql, *lifts) if lifts else sql
        return f

    return add


def micro(c: Column | str) -> Column:
    """A double as whole millionths, which engines agree on."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 1_000_000).cast("long")


def v6(df: DataFrame) -> DataFrame:
    return df.select("z", "x", "y", "px", "py", micro("v").alias("v6"))


KEY = "z, x, y, px, py"
V6 = "CAST(round(v * 1000000) AS BIGINT) AS v6"
#: Dense lattice over a table, and its 3 x 3 neighbourhood with repeated edges.
LATTICE = """tiles AS (SELECT DISTINCT z, x, y FROM {t}), lat AS (SELECT z, x, y, px, py FROM tiles, (SELECT CAST(unnest(range(32)) AS INT) AS px) AS a, (SELECT CAST(unnest(range(32)) AS INT) AS py) AS b)"""
DENSE = LATTICE + """, d AS (SELECT lat.*, {cols} FROM lat LEFT JOIN {t} AS t ON t.z = lat.z AND t.x = lat.x AND t.y = lat.y AND t.px = lat.px AND t.py = lat.py)"""


def near(column: str, table: str = "d", name: str = "nb") -> str:
    """CTE ``name``: the dense table with the 3 x 3 neighbours of a column, edges repeated."""
    row, col = "OVER (PARTITION BY z, x, y, py ORDER BY px)", "OVER (PARTITION BY z, x, y, px ORDER BY py)"
    up = ", ".join(f"CASE WHEN py = 0 THEN {k} ELSE lag({k}) {col} END AS {n}" for k, n in (("w", "nw"), ("c", "n"), ("e", "ne")))
    down = ", ".join(f"CASE WHEN py = 31 THEN {k} ELSE lead({k}) {col} END AS {n}" for k, n in (("w", "sw"), ("c", "s"), ("e", "se")))
    return f"""{name}_h AS (SELECT z, x, y, px, py, {column} AS c, CASE WHEN px = 0 THEN {column} ELSE lag({column}) {row} END AS w, CASE WHEN px = 31 THEN {column} ELSE lead({column}) {row} END AS e FROM {table}),
{name} AS (SELECT z, x, y, px, py, c, w, e, {up}, {down} FROM {name}_h)"""


#: Straight channels of a pixel row.
STRAIGHT = "CASE WHEN a > 0 THEN {c} / CAST(a AS DOUBLE) ELSE 0 END"
S_R, S_G, S_B = (STRAIGHT.format(c=c) for c in "rgb")


def sql_byte(e: str) -> str:
    return f"CAST(least(greatest(round(({e}) * 255), 0), 255) AS INT)"


def recolored(f, alpha: str = "a / CAST(255 AS DOUBLE)", out_a: str = "a", table: str = "lift_pixels") -> str:
    """SELECT that maps straight r, g, b (names sr, sg, sb) through ``f`` and premultiplies again."""
    cols = ", ".join(f"CASE WHEN a > 0 THEN {sql_byte(f'({f(c)}) * ({alpha})')} ELSE 0 END AS {c}" for c in "rgb")
    return f"SELECT {KEY}, {cols}, {out_a} AS a FROM (SELECT *, {S_R} AS sr, {S_G} AS sg, {S_B} AS sb FROM {table}) AS s"


PRIME = 2147483647


def sql_hash(*parts: str, salt: str | int = 0) -> str:
    """SQL of ``raster.cell_hash``."""
    h = f"CAST(({salt}) % {PRIME} AS BIGINT)"
    for p in parts:
        h = f"(({h} * 48271 + CAST({p} AS BIGINT) % {PRIME} * 69621 + 12345) % {PRIME})"
        h = f"(({h} * 16807 + CAST(floor({h} / CAST(65536 AS DOUBLE)) AS BIGINT)) % {PRIME})"
    return h


def sql_draw(*parts: str, salt: str | int = 0) -> str:
    """The hash as a share of 1."""
    return f"({sql_hash(*parts, salt=salt)} / CAST({PRIME} AS DOUBLE))"
