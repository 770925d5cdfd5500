"""Queries of the scalar-field operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.arith import FUNCTIONS, apply
from ..operators import field as O
from ..operators.grid import Grid
from ..sources.lift import field, lifted
from .registry import DENSE, KEY, V6, micro, near, query, sql_byte, v6

D = DENSE.format(t="lift_field", cols="v")
STOPS = [(0.0, "#203040"), (0.25, "#3060c0"), (0.5, "#40c080"), (1.0, "#f0e040")]


def _points(spark, d, where=None):
    p = lifted(spark, d, "lift_tiled")
    p = p.where(where) if where is not None else p
    fx = (F.col("lon") + 180) / 360 * 16
    fy = (1 - F.asinh(F.tan(F.radians("lat"))) / F.pi()) / 2 * 16
    return p.withColumns({"fx": (fx - F.floor(fx)) * 32, "fy": (fy - F.floor(fy)) * 32})


FP = """p AS (SELECT z, x, y, kind, value, (gx - floor(gx)) * 32 AS fx, (gy - floor(gy)) * 32 AS fy FROM (SELECT *, (lon + 180) / 360 * 16 AS gx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 16 AS gy FROM lift_tiled) AS g)"""


def _step_sql(v: str, alpha: str = "1.0") -> str:
    out = ""
    for i, c in enumerate("rgb"):
        cases = " ".join(f"WHEN {v} >= {s} THEN {int(h[1 + 2 * i : 3 + 2 * i], 16)}" for s, h in reversed(STOPS))
        out += f", CAST(CASE {cases} ELSE {int(STOPS[0][1][1 + 2 * i : 3 + 2 * i], 16)} END AS INT) AS {c}"
    return out + ", 255 AS a"


@query("density_ramp", f"""WITH {FP}, b AS (SELECT z, x, y, CAST(floor(fx / 2) AS INT) AS px, CAST(floor(fy / 2) AS INT) AS py, sum(value) AS v FROM p WHERE kind IN ('click', 'purchase') GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT z, x, y, px, py, least(greatest(v / 200, 0), 1) AS v FROM b)
SELECT {KEY}{_step_sql('v')} FROM m""", "lift_tiled")  # fmt: skip
def density_ramp(spark, d):
    """Flagship: filtered scan, binned sums per tile, remap, step ramp.

    Sums are rounded to a billionth: else the order of adding decides on which side of a step a bin falls that lies on it.
    """
    p = _points(spark, d, F.col("kind").isin("click", "purchase"))
    bins = p.groupBy("z", "x", "y", F.floor(F.col("fx") / 2).cast("int").alias("px"), F.floor(F.col("fy") / 2).cast("int").alias("py")).agg(F.round(F.sum("value"), 9).alias("v"))
    return O.color_ramp(O.map_range(Grid(bins, 16, 16), 0, 200, 0, 1, clamped=True), STOPS, "step").df


@query("density", f"""WITH {FP}, w AS (SELECT z, value, x * 32 + fx AS wx, y * 32 + fy AS wy FROM p),
q AS (SELECT *, floor(wx) + i AS qx, floor(wy) + j AS qy FROM w, (SELECT unnest(range(-4, 5)) AS i) AS a, (SELECT unnest(range(-4, 5)) AS j) AS b),
h AS (SELECT *, (pow(qx + 0.5 - wx, 2) + pow(qy + 0.5 - wy, 2)) / 9 AS d2 FROM q WHERE qy >= 0 AND qy < 512),
k AS (SELECT *, CAST((CAST(qx AS BIGINT) + 512) % 512 AS INT) AS gx, CAST(qy AS INT) AS gy FROM h WHERE d2 < 1)
SELECT z, CAST(floor(gx / 32.0) AS INT) AS x, CAST(floor(gy / 32.0) AS INT) AS y, gx % 32 AS px, gy % 32 AS py,
CAST(round(sum(value * {1 / math.sqrt(2 * math.pi)!r} * exp(-4.5 * d2)) * 1000) AS BIGINT) AS v3 FROM k GROUP BY ALL""", "lift_tiled")  # fmt: skip
def density(spark, d):
    """Kernels reach into the tiles around."""
    out = O.density(_points(spark, d), 32, 3.0, weight=F.col("value"))
    return out.df.select("z", "x", "y", "px", "py", F.round(F.col("v") * 1000).cast("long").alias("v3"))


@query("map_range", f"SELECT {KEY}, {V6} FROM (SELECT {KEY}, least(greatest(10 + (v - 20) / 100.0 * (-5), 5), 10) AS v FROM lift_field) AS m", "lift_field")
def map_range(spark, d):
    return v6(O.map_range(field(spark, d), 20, 120, 10, 5, clamped=True).df)


@query("threshold", f"SELECT {KEY}, {V6} FROM (SELECT {KEY}, 1 + 2 * least(greatest((v - 50) / 40, 0), 1) AS v FROM lift_field) AS m", "lift_field")
def threshold(spark, d):
    return v6(O.threshold(field(spark, d), 70, 1, 3, softness=40).df)


@query("threshold_hard", f"SELECT {KEY}, {V6} FROM (SELECT {KEY}, CASE WHEN v <= 70 THEN 0.0 ELSE 1.0 END AS v FROM lift_field) AS m", "lift_field")
def threshold_hard(spark, d):
    return v6(O.threshold(field(spark, d), 70).df)


@query("field_math", f"""SELECT {KEY}, {V6} FROM (SELECT a.z, a.x, a.y, a.px, a.py, CASE WHEN b.v - 60 <> 0 THEN a.v / (b.v - 60) END AS v FROM lift_field AS a JOIN lift_field AS b ON a.z = b.z AND a.x = b.x AND a.y = b.y AND a.px = b.px AND a.py = b.py) AS m""", "lift_field")
def field_math(spark, d):
    f = field(spark, d, by_pixel=True)
    return v6(O.field_math("div", f, O.field_math("sub", f, 60.0)).df)


MATH_SQL = {
    "abs": "abs(a)", "neg": "-a", "floor": "floor(a)", "ceil": "ceil(a)", "round": "round(a)", "fract": "a - floor(a)", "sign": "sign(a)",
    "sqrt": "CASE WHEN a >= 0 THEN sqrt(a) END", "exp": "exp(a)", "log": "CASE WHEN a > 0 THEN ln(a) END", "log2": "CASE WHEN a > 0 THEN log2(a) END", "log10": "CASE WHEN a > 0 THEN log10(a) END",
    "sin": "sin(a)", "cos": "cos(a)", "tan": "tan(a)", "asin": "CASE WHEN abs(a) <= 1 THEN asin(a) END", "acos": "CASE WHEN abs(a) <= 1 THEN acos(a) END", "atan": "atan(a)", "atan2": "atan2(a, b)",
    "step": "CASE WHEN b < a THEN 0.0 ELSE 1.0 END", "smoothstep": "CASE WHEN a = b THEN CASE WHEN c < a THEN 0.0 ELSE 1.0 END ELSE pow(least(greatest((c - a) / (b - a), 0), 1), 2) * (3 - 2 * least(greatest((c - a) / (b - a), 0), 1)) END",
    "add": "a + b", "sub": "a - b", "mul": "a * b", "div": "CASE WHEN b <> 0 THEN a / b END", "mod": "CASE WHEN b <> 0 THEN a - abs(b) * floor(a / abs(b)) END", "min": "least(a, b)", "max": "greatest(a, b)",
    "pow": "CASE WHEN a > 0 OR a = 0 AND b >= 0 OR a < 0 AND b = floor(b) THEN pow(a, b) END", "clamp": "greatest(least(a, greatest(b, c)), least(b, c))", "lerp": "a + (b - a) * c",
}


@query("math_functions", "WITH o AS (SELECT event_id, (event_id % 41 - 20) / CAST(4 AS DOUBLE) AS a, (event_id % 7 - 3) / CAST(2 AS DOUBLE) AS b, (event_id % 5 - 2) / CAST(4 AS DOUBLE) AS c FROM events) SELECT event_id, "
       + ", ".join(f"CAST(round(({s}) * 1000000) AS BIGINT) AS m_{n}" for n, s in MATH_SQL.items() if n != "tan") + " FROM o")
def math_functions(spark, d):
    e = F.col("event_id")
    a, b, c = (e % 41 - 20) / F.lit(4.0), (e % 7 - 3) / F.lit(2.0), (e % 5 - 2) / F.lit(4.0)
    own = {n: micro(apply(n, *(a, b, c)[: FUNCTIONS[n][0]])) for n in MATH_SQL if n != "tan"}
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", *[x.alias(f"m_{n}") for n, x in own.items()])


def _linear_sql(v: str) -> str:
    out = []
    for i in range(3):
        h = [int(c[1 + 2 * i : 3 + 2 * i], 16) for _, c in STOPS]
        cases = " ".join(f"WHEN {v} >= {a} THEN {p} + ({q} - {p}) * ({v} - {a}) / ({b} - {a})" for (a, _), (b, _), p, q in reversed(list(zip(STOPS[:-1], STOPS[1:], h[:-1], h[1:]))))
        out.append(f"CASE WHEN {v} >= {STOPS[-1][0]} THEN {h[-1]} {cases} ELSE {h[0]} END")
    return ", ".join(f"CAST(round(round({e}) * 0.5) AS INT) AS {c}" for e, c in zip(out, "rgb")) + ", 128 AS a"


@query("color_ramp", f"SELECT {KEY}, {_linear_sql('v')} FROM (SELECT {KEY}, v / 130 AS v FROM lift_field) AS m", "lift_field")
def color_ramp(spark, d):
    return O.color_ramp(O.map_range(field(spark, d), 0, 130, 0, 1), STOPS, opacity=0.5).df


_GRAD = f"""{D}, {near('v')}, z9 AS (SELECT {KEY}, c, {', '.join(f'coalesce({k}, c) AS {k}' for k in 'nw n ne w e sw s se'.split())} FROM nb),
g AS (SELECT {KEY}, c AS v, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 240 AS gx, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / 240 AS gy FROM z9)"""


def _grey(e: str) -> str:
    return f"{sql_byte(e)} AS r, {sql_byte(e)} AS g, {sql_byte(e)} AS b, 255 AS a"


@query("slope", f"WITH {_GRAD} SELECT {KEY}, {_grey(f'1 - least(atan(sqrt(gx * gx + gy * gy)) / {math.radians(60)!r}, 1)')} FROM g WHERE v IS NOT NULL", "lift_field")
def slope(spark, d):
    return O.slope(field(spark, d), 60, invert=True).df


def _shade(az: float, alt: float = 45.0, k: float = 1.0) -> str:
    z, t = math.pi / 2 - math.radians(alt), math.radians(450 - az)
    return f"(({math.cos(z)!r} + {math.sin(z)!r} * (-gx * {k} * {math.cos(t)!r} + gy * {k} * {math.sin(t)!r})) / sqrt(1 + gx * {k} * gx * {k} + gy * {k} * gy * {k}))"


@query("hillshade", f"WITH {_GRAD} SELECT {KEY}, {_grey(f'least(greatest({_shade(315)}, 0), 1)')} FROM g WHERE v IS NOT NULL", "lift_field")
def hillshade(spark, d):
    return O.hillshade(field(spark, d)).df


_MULTI = f"least(greatest({_shade(225, 45, 2.0)} / 6 + {_shade(270, 45, 2.0)} / 3 + {_shade(315, 45, 2.0)} / 3 + {_shade(360, 45, 2.0)} / 6, 0), 1)"
_FLAT = repr(math.cos(math.pi / 2 - math.radians(45)))


@query("hillshade_relief", f"""WITH {_GRAD}, s AS (SELECT {KEY}, {_MULTI} AS t FROM g WHERE v IS NOT NULL), q AS (SELECT {KEY}, t < {_FLAT} AS low, least(greatest(CASE WHEN t < {_FLAT} THEN ({_FLAT} - t) / {_FLAT} ELSE (t - {_FLAT}) / (1 - {_FLAT}) END, 0), 1) AS al FROM s)
SELECT {KEY}, {sql_byte(f"CASE WHEN low THEN 0.2 ELSE 1.0 END * al")} AS r, {sql_byte("CASE WHEN low THEN 0 ELSE 1.0 END * al")} AS g, {sql_byte("CASE WHEN low THEN 0.4 ELSE 0.8 END * al")} AS b, {sql_byte('al')} AS a FROM q""", "lift_field")  # fmt: skip
def hillshade_relief(spark, d):
    return O.hillshade(field(spark, d), exaggeration=2.0, multidirectional=True, mode="relief", shadow="#330066", highlight="#ffffcc").df


@query("flow_field", f"""WITH {_GRAD}, h AS (SELECT {KEY}, coalesce(gx, 0) AS gx, coalesce(gy, 0) AS gy, sqrt(coalesce(gx, 0) * coalesce(gx, 0) + coalesce(gy, 0) * coalesce(gy, 0)) AS m FROM g),
u AS (SELECT {KEY}, CASE WHEN m > 0 THEN -gx / m * least(atan(m) / {math.radians(45)!r}, 1) ELSE 0 END AS dx, CASE WHEN m > 0 THEN -gy / m * least(atan(m) / {math.radians(45)!r}, 1) ELSE 0 END AS dy FROM h)
SELECT {KEY}, {sql_byte('0.5 + 0.5 * dy')} AS r, {sql_byte('0.5 - 0.5 * dx')} AS g, 0 AS b, 255 AS a FROM u""", "lift_field")  # fmt: skip
def flow_field(spark, d):
    return O.flow_field(field(spark, d), "along").df


@query("dem_decode", f"SELECT {KEY}, {V6} FROM (SELECT {KEY}, r * 256.0 + g + b / 256.0 - 32768 AS v FROM lift_pixels) AS m", "lift_pixels")
def dem_decode(spark, d):
    from ..sources.lift import pixels

    return v6(O.dem_decode(pixels(spark, d)).df)


_SIDE = {"n": "px + (level - c) / (e - c), py", "e": "px + 1, py + (level - e) / (se - e)", "s": "px + (level - s) / (se - s), py + 1", "w": "px, py + (level - c) / (s - c)"}


def _end(i: int, axis: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v.split(', ')[axis]}" for k, v in _SIDE.items())
    return f"CASE substr(piece, {i}, 1) {cases} END"


_ENDS = ", ".join(f"{_end(i, a)} AS {n}" for i, a, n in ((1, 0, "x0"), (1, 1, "y0"), (2, 0, "x1"), (2, 1, "y1")))
#: Written from the rule: what is above the level is on a piece's left, going through the cell's corners nw, ne, se, sw.
_CELLS = "(1, 0, 'sw'), (2, 0, 'es'), (3, 0, 'ew'), (4, 0, 'ne'), (6, 0, 'ns'), (7, 0, 'nw'), (8, 0, 'wn'), (9, 0, 'sn'), (11, 0, 'en'), (12, 0, 'we'), (13, 0, 'se'), (14, 0, 'ws')"
_SADDLES = "(5, 0, 'ne'), (5, 1, 'sw'), (10, 0, 'wn'), (10, 1, 'es'), (105, 0, 'nw'), (105, 1, 'se'), (110, 0, 'en'), (110, 1, 'ws')"


@query("contour_segments", f"""WITH {D}, {near('v')}, l AS (SELECT *, unnest([40.0, 80.0, 120.0]) AS level FROM nb WHERE px < 31 AND py < 31 AND c IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AND se IS NOT NULL),
k AS (SELECT *, (c > level)::INT * 8 + (e > level)::INT * 4 + (se > level)::INT * 2 + (s > level)::INT AS corners, (c + e + s + se) / 4 > level AS middle FROM l),
m AS (SELECT *, corners + CASE WHEN corners IN (5, 10) AND middle THEN 100 ELSE 0 END AS cs FROM k),
p AS (SELECT m.*, part, {_ENDS} FROM m JOIN (VALUES {_CELLS}, {_SADDLES}) AS t(cs, part, piece) USING (cs))
SELECT {KEY}, CAST(level AS INT) AS level, part, {', '.join(f"CAST(round({c} * 1000) AS BIGINT) AS {c}" for c in ("x0", "y0", "x1", "y1"))} FROM p WHERE x0 <> x1 OR y0 <> y1""", "lift_field")  # fmt: skip
def contour_segments(spark, d):
    s = O.contour_segments(field(spark, d), [40.0, 80.0, 120.0])
    ends = [F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return s.select("z", "x", "y", "px", "py", F.col("level").cast("int").alias("level"), "part", *ends)


@query("contour_lines")
def contour_lines(spark, d):
    f = field(spark, d)
    return O.contour_lines(O.contour_segments(f, O.contour_levels(f, 40.0)))
