"""Queries of the raster operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import raster as O
from ..operators.grid import BANDS, Grid
from ..sources.lift import field, pixels
from .registry import DENSE, KEY, PRIME, V6, near, query, recolored, sql_byte, sql_draw, v6

PX = "lift_pixels"
D4 = DENSE.format(t=PX, cols="coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a")


def clip01(e: str) -> str:
    return f"least(greatest({e}, 0), 1)"


def _op(name: str, sql: str, run) -> None:
    query(name, sql, PX)(lambda spark, d: run(pixels(spark, d)).df)


_op("invert", f"SELECT {KEY}, a - r AS r, a - g AS g, a - b AS b, a FROM lift_pixels", O.invert)
_op("brightness_contrast", recolored(lambda c: clip01(f"(s{c} - 0.5) * 1.3 + 0.5 + 0.1")), lambda p: O.brightness_contrast(p, 0.1, 0.3))
_op("posterize", recolored(lambda c: clip01(f"round(s{c} * 4) / 4")), lambda p: O.posterize(p, 5))
_op("levels", recolored(lambda c: clip01(f"pow({clip01(f'(s{c} - 0.1) / 0.8')}, {1 / 1.5!r}) * 0.7 + 0.2")), lambda p: O.levels(p, 0.1, 0.9, 1.5, 0.2, 0.9))
_K = "greatest(abs(sr - 0.2), abs(sg - 0.4), abs(sb - 0.6))"
_C = f"(a / CAST(255 AS DOUBLE) * CASE WHEN {_K} <= 0.3 THEN 0 WHEN {_K} >= 0.5 THEN 1 ELSE ({_K} - 0.3) / (0.5 - 0.3) END)"
_op("color_to_alpha", recolored(lambda c: f"s{c}", _C, f"CASE WHEN a > 0 THEN {sql_byte(_C)} ELSE 0 END"), lambda p: O.color_to_alpha(p, "#336699", 0.3, 0.2))
_L = "(0.299 * sr + 0.587 * sg + 0.114 * sb)"
_op("channel_shuffle", f"SELECT {KEY}, {sql_byte(f'{_L} * sr')} AS r, {sql_byte('sb * sr')} AS g, {sql_byte('sr')} AS b, {sql_byte('sr')} AS a FROM (SELECT *, CASE WHEN a > 0 THEN r / CAST(a AS DOUBLE) ELSE 0 END AS sr, CASE WHEN a > 0 THEN g / CAST(a AS DOUBLE) ELSE 0 END AS sg, CASE WHEN a > 0 THEN b / CAST(a AS DOUBLE) ELSE 0 END AS sb FROM lift_pixels) AS s",
    lambda p: O.channel_shuffle(p, "luminance", "b", "1", "r"))
query("pick_channel", f"SELECT {KEY}, {V6} FROM (SELECT {KEY}, CASE WHEN a > 0 THEN 0.299 * (r / CAST(a AS DOUBLE)) + 0.587 * (g / CAST(a AS DOUBLE)) + 0.114 * (b / CAST(a AS DOUBLE)) ELSE 0 END AS v FROM lift_pixels) AS m", PX)(lambda spark, d: v6(O.pick_channel(pixels(spark, d)).df))


def _hsl_sql(shift: float, sat: str, light: str) -> str:
    return f"""WITH s AS (SELECT *, least(r / CAST(a AS DOUBLE), 1) AS sr, least(g / CAST(a AS DOUBLE), 1) AS sg, least(b / CAST(a AS DOUBLE), 1) AS sb FROM lift_pixels WHERE a > 0),
m AS (SELECT *, greatest(sr, sg, sb) AS hi, least(sr, sg, sb) AS lo FROM s),
h AS (SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi - lo < 0.000001 THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s,
CASE WHEN hi - lo < 0.000001 THEN 0 WHEN hi = sr THEN ((sg - sb) / (hi - lo) - 6 * floor((sg - sb) / (hi - lo) / 6)) * 60 WHEN hi = sg THEN ((sb - sr) / (hi - lo) + 2) * 60 ELSE ((sr - sg) / (hi - lo) + 4) * 60 END AS h FROM m),
q AS (SELECT *, (h + {shift}) - 360 * floor((h + {shift}) / 360) AS h2, {sat} AS s2, {light} AS l2 FROM h),
c AS (SELECT *, (1 - abs(2 * l2 - 1)) * s2 AS cc, (1 - abs(2 * l2 - 1)) * s2 * (1 - abs(h2 / 60 - 2 * floor(h2 / 120) - 1)) AS xx, floor(h2 / 60) AS k FROM q)
SELECT {KEY}, {sql_byte(clip01("CASE WHEN k IN (0, 5) THEN cc WHEN k IN (1, 4) THEN xx ELSE 0 END + l2 - cc / 2") + " * (a / CAST(255 AS DOUBLE))")} AS r,
{sql_byte(clip01("CASE WHEN k IN (1, 2) THEN cc WHEN k IN (0, 3) THEN xx ELSE 0 END + l2 - cc / 2") + " * (a / CAST(255 AS DOUBLE))")} AS g,
{sql_byte(clip01("CASE WHEN k IN (3, 4) THEN cc WHEN k IN (2, 5) THEN xx ELSE 0 END + l2 - cc / 2") + " * (a / CAST(255 AS DOUBLE))")} AS b, a FROM c"""


_op("hsl", _hsl_sql(40.0, "s + s * (-0.3)", "l + (1 - l) * 0.1"), lambda p: O.hsl(p, 40.0, -0.3, 0.1))

_LAB = """lab AS (SELECT *, 116 * fy - 16 AS ll, 500 * (fx - fy) AS la, 200 * (fy - fz) AS lb FROM (SELECT *, {f} FROM (SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lbb) / 0.95047 AS tx, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lbb AS ty, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lbb) / 1.08883 AS tz
FROM (SELECT *, {lin} FROM (SELECT *, least(r / CAST(a AS DOUBLE), 1) AS sr, least(g / CAST(a AS DOUBLE), 1) AS sg, least(b / CAST(a AS DOUBLE), 1) AS sb FROM lift_pixels WHERE a > 0) AS s0) AS s1) AS s2) AS s3)""".format(
    f=", ".join(f"CASE WHEN t{k} > {216 / 24389!r} THEN cbrt(t{k}) ELSE ({24389 / 27!r} * t{k} + 16) / 116 END AS f{k}" for k in "xyz"),
    lin=", ".join(f"CASE WHEN s{c} <= 0.04045 THEN s{c} / 12.92 ELSE pow((s{c} + 0.055) / 1.055, 2.4) END AS {n}" for c, n in zip("rgb", ("lr", "lg", "lbb"))),
)


def _chroma_sql(k: str) -> str:
    from ..functions.color import FROM_XYZ

    inv = ", ".join(f"(CASE WHEN pow({g}, 3) > {216 / 24389!r} THEN pow({g}, 3) ELSE (116 * {g} - 16) / {24389 / 27!r} END) * {w} AS c{n}" for n, g, w in (("x", "gx", 0.95047), ("y", "gy", 1.0), ("z", "gz", 1.08883)))
    rgb = ", ".join(f"{m[0]} * cx + ({m[1]}) * cy + ({m[2]}) * cz AS oc_{c}" for c, m in zip("rgb", FROM_XYZ))
    back = lambda c: clip01(f"CASE WHEN oc_{c} <= 0.0031308 THEN 12.92 * oc_{c} ELSE 1.055 * pow(greatest(oc_{c}, 0), {1 / 2.4!r}) - 0.055 END")
    return f"WITH {_LAB}, kk AS (SELECT *, {k} AS k FROM lab), g AS (SELECT *, (ll + 16) / 116 AS gy, (ll + 16) / 116 + la * k / 500 AS gx, (ll + 16) / 116 - lb * k / 200 AS gz FROM kk), i AS (SELECT *, {inv} FROM g), o AS (SELECT *, {rgb} FROM i) SELECT {KEY}, " + ", ".join(f"{sql_byte(back(c) + ' * (a / CAST(255 AS DOUBLE))')} AS {c}" for c in "rgb") + ", a FROM o"


_op("saturate", _chroma_sql("1.4"), lambda p: O.saturate(p, 1.4))
_op("vibrance", _chroma_sql("greatest(1 + 0.6 * (1 - least(sqrt(la * la + lb * lb) / 100, 1)), 0)"), lambda p: O.vibrance(p, 0.6))

PALETTE = ["#102030", "#c04020", "#40a060", "#e0e0d0", "#2050b0"]


def _nearest_sql(source: str) -> str:
    d = [f"pow(q_r - {int(p[1:3], 16) / 255!r}, 2) + pow(q_g - {int(p[3:5], 16) / 255!r}, 2) + pow(q_b - {int(p[5:7], 16) / 255!r}, 2)" for p in PALETTE]
    pick = lambda i: "CASE " + " ".join(f"WHEN m = d{k} THEN {int(p[1 + 2 * i : 3 + 2 * i], 16) / 255!r}" for k, p in enumerate(PALETTE)) + " END"
    dk = ", ".join(f"{e} AS d{k}" for k, e in enumerate(d))
    m = "least(" + ", ".join(f"d{k}" for k in range(len(d))) + ")"
    cols = ", ".join(f"{sql_byte(f'({pick(i)}) * (a / CAST(255 AS DOUBLE))')} AS {c}" for i, c in enumerate("rgb"))
    return f"SELECT {KEY}, {cols}, a FROM (SELECT *, {m} AS m FROM (SELECT *, {dk} FROM ({source}) AS s0) AS s1) AS s2"


_op("quantize", _nearest_sql("SELECT *, r / CAST(a AS DOUBLE) AS q_r, g / CAST(a AS DOUBLE) AS q_g, b / CAST(a AS DOUBLE) AS q_b FROM lift_pixels WHERE a > 0"), lambda p: O.quantize(p, PALETTE, "rgb"))
_BIAS = "(([" + ", ".join(str(v) for row in O.BAYER for v in row) + "][(py % 4) * 4 + px % 4 + 1] + 0.5) / 16 - 0.5) * 0.8"
_op("dither_ordered", _nearest_sql("SELECT *, " + ", ".join(f"{clip01(f'{c} / CAST(a AS DOUBLE) + {_BIAS}')} AS q_{c}" for c in "rgb") + " FROM lift_pixels WHERE a > 0"), lambda p: O.dither(p, PALETTE, amount=0.8))
query("quantize_lab")(lambda spark, d: O.quantize(pixels(spark, d), PALETTE).df)
query("dither_diffusion")(lambda spark, d: O.dither(pixels(spark, d), PALETTE, "floyd-steinberg").df)
_COS, _SIN = math.cos(math.radians(30)), math.sin(math.radians(30))
_TURN3 = [(2 * _COS + 1) / 3, (-math.sqrt(3) * _SIN - _COS + 1) / 3, (math.sqrt(3) * _SIN - _COS + 1) / 3]
_HUED = [" + ".join(f"s{c} * {_TURN3[(j - i) % 3]!r}" for j, c in enumerate("rgb")) for i in range(3)]
_MEAN = "(" + " + ".join(f"({h})" for h in _HUED) + ") / 3"
_ADJUSTED = {c: clip01(f"0.1 + 0.8 * (((({h}) + ({_MEAN} - ({h})) * {1 - 1 / (1.001 - 0.2)!r}) - 0.5) * {1 / 0.9!r} + 0.5)") for c, h in zip("rgb", _HUED)}
_op("raster_adjust", recolored(lambda c: _ADJUSTED[c], "a / CAST(255 AS DOUBLE) * 0.8", f"CASE WHEN a > 0 THEN {sql_byte('a / CAST(255 AS DOUBLE) * 0.8')} ELSE 0 END"), lambda p: O.adjust(p, 0.8, 30.0, 0.2, 0.1, 0.1, 0.9))

# Two rasters
_PAIR = """j AS (SELECT coalesce(p.z, o.z) AS z, coalesce(p.x, o.x) AS x, coalesce(p.y, o.y) AS y, coalesce(p.px, o.px) AS px, coalesce(p.py, o.py) AS py, """ + ", ".join(f"coalesce(p.{c}, 0) AS b_{c}, coalesce(o.{c}, 0) AS s_{c}" for c in BANDS) + """ FROM lift_pixels AS p FULL JOIN lift_overlay AS o ON p.z = o.z AND p.x = o.x AND p.y = o.y AND p.px = o.px AND p.py = o.py)"""
_DIV = "((({e}) + 128 + (({e}) + 128) // 256) // 256)"


def _both(name: str, sql: str, run) -> None:
    query(name, sql, PX, "lift_overlay")(lambda spark, d: run(pixels(spark, d, by_pixel=True), pixels(spark, d, "lift_overlay", by_pixel=True)).df)


_OVER = ", ".join(f"CAST(s_{c} + {_DIV.format(e=f'b_{c} * (255 - s_a)')} AS INT) AS {c}" for c in BANDS)
_both("blend_normal", f"WITH {_PAIR} SELECT {KEY}, {_OVER} FROM j", lambda p, o: O.blend(p, o))


def _blend_sql(mode, fs: str, fb: str, op: float = 1.0) -> str:
    un = ", ".join(f"CASE WHEN {k}_a > 0 THEN {k}_{c} / CAST({k}_a AS DOUBLE) ELSE 0 END AS {k}{c}" for k in "bs" for c in "rgb")
    cols = ", ".join(f"{sql_byte(f'sa * ({fs}) * ((1 - ba) * s{c} + ba * ({mode(f'b{c}', f's{c}')})) + ba * ({fb}) * b{c}')} AS {c}" for c in "rgb")
    return f"WITH {_PAIR}, u AS (SELECT *, s_a / CAST(255 AS DOUBLE) * {op} AS sa, b_a / CAST(255 AS DOUBLE) AS ba, {un} FROM j) SELECT {KEY}, {cols}, {sql_byte(f'sa * ({fs}) + ba * ({fb})')} AS a FROM u"


MODE_SQL = {
    "multiply": lambda b, s: f"{b} * {s}", "screen": lambda b, s: f"{b} + {s} - {b} * {s}", "darken": lambda b, s: f"least({b}, {s})", "lighten": lambda b, s: f"greatest({b}, {s})",
    "overlay": lambda b, s: f"CASE WHEN {b} <= 0.5 THEN 2 * {s} * {b} ELSE 1 - 2 * (1 - {s}) * (1 - {b}) END", "hard-light": lambda b, s: f"CASE WHEN {s} <= 0.5 THEN 2 * {b} * {s} ELSE 1 - 2 * (1 - {b}) * (1 - {s}) END",
    "color-dodge": lambda b, s: f"CASE WHEN {b} <= 0 THEN 0 WHEN {s} >= 1 THEN 1 ELSE least({b} / (1 - {s}), 1) END", "color-burn": lambda b, s: f"CASE WHEN {b} >= 1 THEN 1 WHEN {s} <= 0 THEN 0 ELSE 1 - least((1 - {b}) / {s}, 1) END",
    "soft-light": lambda b, s: f"CASE WHEN {s} <= 0.5 THEN {b} - (1 - 2 * {s}) * {b} * (1 - {b}) ELSE {b} + (2 * {s} - 1) * (CASE WHEN {b} <= 0.25 THEN ((16 * {b} - 12) * {b} + 4) * {b} ELSE sqrt({b}) END - {b}) END",
    "difference": lambda b, s: f"abs({b} - {s})", "exclusion": lambda b, s: f"{b} + {s} - 2 * {b} * {s}",
}
for _m, _s in MODE_SQL.items():
    _both(f"blend_{_m.replace('-', '_')}", _blend_sql(_s, "1", "1 - sa", 0.7), lambda p, o, m=_m: O.blend(p, o, m, opacity=0.7))
COMPOSITE_SQL = {"source-atop": ("ba", "1 - sa"), "destination-over": ("1 - ba", "1"), "source-in": ("ba", "0"), "source-out": ("1 - ba", "0"), "destination-in": ("0", "sa"), "destination-out": ("0", "1 - sa"), "destination-atop": ("1 - ba", "sa"), "xor": ("1 - ba", "1 - sa")}
for _c, (_fs, _fb) in COMPOSITE_SQL.items():
    _both(f"composite_{_c.replace('-', '_')}", _blend_sql(lambda b, s: s, _fs, _fb), lambda p, o, c=_c: O.blend(p, o, composite=c))
for _m in O.WHOLE_MODES:
    query(f"blend_{_m}")(lambda spark, d, m=_m: O.blend(pixels(spark, d, by_pixel=True), pixels(spark, d, "lift_overlay", by_pixel=True), m).df)

_both("stack", f"WITH {_PAIR}, one AS (SELECT {KEY}, {_OVER.replace(' AS INT)', ' AS BIGINT)')} FROM j), two AS (SELECT one.*, coalesce(p.g, 0) AS t_r, coalesce(p.r, 0) AS t_g, coalesce(p.b, 0) AS t_b, coalesce(p.a, 0) AS t_a FROM one LEFT JOIN lift_pixels AS p ON p.z = one.z AND p.x = one.x AND p.y = one.y AND p.px = one.px AND p.py = one.py) SELECT {KEY}, "
      + ", ".join(f"CAST(t_{c} + {_DIV.format(e=f'{c} * (255 - t_a)')} AS INT) AS {c}" for c in BANDS) + " FROM two",
      lambda p, o: O.stack([p, o, p.select(r=F.col("g"), g=F.col("r"), b=F.col("b"), a=F.col("a"))]))
_both("mix", f"WITH {_PAIR} SELECT {KEY}, " + ", ".join(f"CAST(round(b_{c} + (s_{c} - b_{c}) * 0.25) AS INT) AS {c}" for c in BANDS) + " FROM j", lambda p, o: O.mix(p, o, 0.25))
query("mix_lab")(lambda spark, d: O.mix(pixels(spark, d, by_pixel=True), pixels(spark, d, "lift_overlay", by_pixel=True), 0.25, "lab").df)

# Neighbourhoods
_SQUARE = "FROM d AS c JOIN d AS n ON n.z = c.z AND n.x = c.x AND n.y = c.y AND abs(n.px - c.px) <= 2 AND abs(n.py - c.py) <= 2 GROUP BY 1, 2, 3, 4, 5"
_op("erode", f"WITH {D4} SELECT c.z, c.x, c.y, c.px, c.py, {', '.join(f'min(n.{b}) AS {b}' for b in BANDS)} {_SQUARE}", lambda p: O.erode(p, 2))
_op("dilate", f"WITH {D4} SELECT c.z, c.x, c.y, c.px, c.py, {', '.join(f'max(n.{b}) AS {b}' for b in BANDS)} {_SQUARE}", lambda p: O.dilate(p, 2))
_DF = DENSE.format(t="lift_field", cols="v")
query("dilate_field", f"WITH {_DF} SELECT {KEY}, {V6} FROM (SELECT c.z, c.x, c.y, c.px, c.py, max(n.v) AS v {_SQUARE}) AS m", "lift_field")(lambda spark, d: v6(O.dilate(field(spark, d), 2).df))
_W = [math.exp(-(i * i) / (2 * 0.8**2)) for i in range(4)]
_KX = lambda axis, other: f"""SELECT z, x, y, px, py, sum(CASE WHEN v IS NOT NULL THEN w * v END) / nullif(sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END), 0) AS v FROM (SELECT c.z, c.x, c.y, c.px, c.py, k.w, n.v FROM {{t}} AS c CROSS JOIN kern AS k JOIN {{t}} AS n ON n.z = c.z AND n.x = c.x AND n.y = c.y AND n.{other} = c.{other} AND n.{axis} = least(greatest(c.{axis} + k.i, 0), 31)) AS q GROUP BY z, x, y, px, py"""
query("blur_field", f"""WITH {_DF}, kern AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_W[abs(i)]!r})' for i in range(-3, 4))}) AS k(i, w)), h AS ({_KX('px', 'py').format(t='d')}), b2 AS ({_KX('py', 'px').format(t='h')}) SELECT {KEY}, {V6} FROM b2""", "lift_field")(lambda spark, d: v6(O.blur(field(spark, d), 0.8).df))
_KERN = ", ".join(f"({i}, {_W[abs(i)] / (_W[0] + 2 * sum(_W[1:]))!r})" for i in range(-3, 4))
_op("blur_raster", f"""WITH {D4}, kern AS (SELECT i, CAST(w AS DOUBLE) AS w FROM (VALUES {_KERN}) AS k(i, w)),
h AS (SELECT c.z, c.x, c.y, c.px, c.py, {', '.join(f'sum(w * n.{b}) AS {b}' for b in BANDS)} FROM d AS c CROSS JOIN kern
  JOIN d AS n ON n.z = c.z AND n.x = c.x AND n.y = c.y AND n.py = c.py AND n.px = least(greatest(c.px + i, 0), 31) GROUP BY ALL)
SELECT c.z, c.x, c.y, c.px, c.py, {', '.join(f'CAST(round(round(sum(w * n.{b}), 9)) AS INT) AS {b}' for b in BANDS)} FROM h AS c CROSS JOIN kern
  JOIN h AS n ON n.z = c.z AND n.x = c.x AND n.y = c.y AND n.px = c.px AND n.py = least(greatest(c.py + i, 0), 31) GROUP BY ALL""", lambda p: O.blur(p, 0.8))  # fmt: skip


def _near4(b: str) -> str:
    return near(b, name=f"nb_{b}")


_JOIN4 = "nb_r AS R JOIN nb_g AS G USING (z, x, y, px, py) JOIN nb_b AS B USING (z, x, y, px, py) JOIN nb_a AS A USING (z, x, y, px, py)"
_op("sharpen", f"WITH {D4}, {', '.join(_near4(b) for b in BANDS)} SELECT {KEY}, " + ", ".join(f"CAST(floor(least(greatest({b.upper()}.c * 3 - 0.5 * ({b.upper()}.n + {b.upper()}.s + {b.upper()}.e + {b.upper()}.w), 0), 255)) AS INT) AS {b}" for b in BANDS) + f" FROM {_JOIN4}", lambda p: O.sharpen(p, 0.5))
_E = lambda t: f"CAST(floor(least(greatest(sqrt(CAST(pow(({t}.ne + 2 * {t}.e + {t}.se) - ({t}.nw + 2 * {t}.w + {t}.sw), 2) + pow(({t}.sw + 2 * {t}.s + {t}.se) - ({t}.nw + 2 * {t}.n + {t}.ne), 2) AS DOUBLE)) * 0.5, 0), 255)) AS INT)"
_op("edge_detect", f"WITH {D4}, {', '.join(_near4(b) for b in BANDS)} SELECT {KEY}, " + ", ".join(f"{_E(b.upper())} AS {b}" for b in BANDS) + f" FROM {_JOIN4}", lambda p: O.edge_detect(p, 0.5))
query("sharpen_field", f"WITH {_DF}, {near('v')} SELECT {KEY}, {V6} FROM (SELECT {KEY}, c * 3 - 0.5 * (coalesce(n, c) + coalesce(s, c) + coalesce(e, c) + coalesce(w, c)) AS v FROM nb) AS m", "lift_field")(lambda spark, d: v6(O.sharpen(field(spark, d), 0.5).df))
_op("mosaic", f"WITH {D4}, k AS (SELECT *, CAST(floor((px + x * 32) / 5.0) AS INT) AS bx, CAST(floor((py + y * 32) / 5.0) AS INT) AS by_ FROM d), m AS (SELECT z, x, y, bx, by_, " + ", ".join(f"CAST(floor(sum({b}) / CAST(count(*) AS DOUBLE)) AS INT) AS m{b}" for b in BANDS) + f" FROM k GROUP BY 1, 2, 3, 4, 5) SELECT {KEY}, " + ", ".join(f"m{b} AS {b}" for b in BANDS) + " FROM k JOIN m USING (z, x, y, bx, by_)", lambda p: O.mosaic(p, 5))
query("displace", f"""WITH {DENSE.format(t='lift_overlay', cols='coalesce(r, 0) AS dr, coalesce(g, 0) AS dg')}, s AS (SELECT {KEY}, px + (dr / CAST(255 AS DOUBLE) - 0.5) * 2 * 3.0 AS sx, py + (dg / CAST(255 AS DOUBLE) - 0.5) * 2 * 3.0 AS sy FROM d),
t AS (SELECT s.*, CAST(least(greatest(floor(sx) + i, 0), 31) AS INT) AS qx, CAST(least(greatest(floor(sy) + j, 0), 31) AS INT) AS qy, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS k FROM s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(i, j))
SELECT t.z, t.x, t.y, t.px, t.py, """ + ", ".join(f"CAST(round(round(sum(k * coalesce(p.{b}, 0)), 9)) AS INT) AS {b}" for b in BANDS) + " FROM t LEFT JOIN lift_pixels AS p ON p.z = t.z AND p.x = t.x AND p.y = t.y AND p.px = t.qx AND p.py = t.qy GROUP BY 1, 2, 3, 4, 5", PX, "lift_overlay")(
    lambda spark, d: O.displace(pixels(spark, d), pixels(spark, d, "lift_overlay"), 3.0).df)

# Generators, over the tiles of the nations
_TILES = "tiles AS (SELECT DISTINCT 3 AS z, CAST(n_nationkey % 8 AS INT) AS x, CAST(n_regionkey AS INT) AS y FROM nation), lat AS (SELECT z, x, y, px, py FROM tiles, (SELECT CAST(unnest(range(32)) AS INT) AS px) AS a, (SELECT CAST(unnest(range(32)) AS INT) AS py) AS b)"


def tiles(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.lit(3).alias("z"), (F.col("n_nationkey") % 8).cast("int").alias("x"), F.col("n_regionkey").cast("int").alias("y")).distinct()


def _gen(name: str, sql: str | None, run, value: bool = False) -> None:
    full = None if sql is None else f"WITH {_TILES}" + (f", m AS (SELECT {KEY}, {sql} AS v FROM lat) SELECT {KEY}, {V6} FROM m" if value else f" SELECT {KEY}, {sql} FROM lat")
    query(name, full)(lambda spark, d: v6(run(tiles(spark, d)).df) if value else run(tiles(spark, d)).df)


_A = 0x80 / 255
_gen("solid", f"{sql_byte(f'{0x30 / 255!r} * {_A!r}')} AS r, {sql_byte(f'{0x60 / 255!r} * {_A!r}')} AS g, {sql_byte(f'{0xC0 / 255!r} * {_A!r}')} AS b, 128 AS a", lambda t: O.solid(t, 32, "#3060c080"))
_DIST = "sqrt(pow(px + 0.5 - 16, 2) + pow(py + 0.5 - 16, 2))"
_gen("circle", f"CASE WHEN {_DIST} <= 6.4 THEN 1.0 WHEN {_DIST} >= 12.8 THEN 0.0 ELSE 1 - ({_DIST} - 6.4) / 6.4 END", lambda t: O.circle(t, 32, 0.4, 0.5), True)
_UX, _UY = "((px + 0.5) / 32)", "((py + 0.5) / 32)"
_gen("gradient_linear", clip01(f"({_UX} * 0.77 + ({_UY} - 0.1) * 0.43) / {0.77 * 0.77 + 0.43 * 0.43!r}"), lambda t: O.gradient(t, 32, "linear", start=(0.0, 0.1), end=(0.77, 0.53)), True)
_gen("gradient_radial", clip01(f"sqrt(pow(({_UX} - 0.5) / 1.5, 2) + pow({_UY} - 0.5, 2)) / 0.5"), lambda t: O.gradient(t, 32, "radial", aspect=1.5), True)
_gen("gradient_diamond", clip01(f"(abs((x + {_UX}) / 8 - 0.5) + abs((y + {_UY}) / 8 - 0.5)) / 0.5"), lambda t: O.gradient(t, 32, "diamond", anchor="world"), True)
_TURN = f"((atan2({_UY} - 0.5, {_UX} - 0.5) - {math.radians(30)!r}) / {2 * math.pi!r})"
_gen("gradient_conic", f"{_TURN} - floor({_TURN})", lambda t: O.gradient(t, 32, "conic", start_angle_deg=30.0), True)
_gen("noise_white", f"{sql_draw('px + x * 32', 'py + y * 32', salt=7)} * 2 - 1", lambda t: O.noise(t, 32, "white", seed=7), True)


def _noise_sql(kind: str) -> str:
    """Two octaves of noise of 8 pixels with seed 3: the numbers of a place's cell and those around, folded by kind."""
    around = "(-1), (0), (1)" if kind in ("worley", "cell") else "(0), (1)"
    number = lambda s: sql_draw(f"((i + dx) % {PRIME} + {PRIME}) % {PRIME}", f"((j + dy) % {PRIME} + {PRIME}) % {PRIME}", salt=f"(3 + o) * 4 + {s}")
    fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"
    share = " * ".join(f"CASE WHEN d{a} = 1 THEN {fade('f' + a)} ELSE 1 - {fade('f' + a)} END" for a in "xy")
    d = f"sqrt(pow(dx + {number(1)} - fx, 2) + pow(dy + {number(2)} - fy, 2))"
    slope = f"(cos({number(0)} * {2 * math.pi!r}) * (fx - dx) + sin({number(0)} * {2 * math.pi!r}) * (fy - dy)) * {math.sqrt(2)!r}"
    fold = {
        "value": f"sum({share} * ({number(0)} * 2 - 1))",
        "perlin": f"sum({share} * {slope})",
        "worley": f"1 - 2 * least(min({d}), 1)",
        "cell": f"min_by({number(3)}, {d}) * 2 - 1",
    }[kind]
    return f"""WITH {_TILES}, u AS (SELECT *, (px + x * 32) / 8.0 * (o + 1) AS u, (py + y * 32) / 8.0 * (o + 1) AS v FROM lat, (VALUES (0), (1)) AS k(o)),
f AS (SELECT *, CAST(floor(u) AS BIGINT) AS i, CAST(floor(v) AS BIGINT) AS j, u - floor(u) AS fx, v - floor(v) AS fy FROM u),
n AS (SELECT {KEY}, o, {fold} AS n FROM f, (VALUES {around}) AS a(dx), (VALUES {around}) AS b(dy) GROUP BY {KEY}, o)
SELECT {KEY}, CAST(round(least(greatest(sum(n * CASE WHEN o = 0 THEN 1 ELSE 0.5 END) / 1.5, -1), 1) * 1000000) AS BIGINT) AS v6 FROM n GROUP BY {KEY}"""


for _k in ("value", "perlin", "worley", "cell"):
    query(f"noise_{_k}", _noise_sql(_k))(lambda spark, d, k=_k: v6(O.noise(tiles(spark, d), 32, k, 8.0, octaves=2, seed=3).df))
query("noise_simplex")(lambda spark, d: v6(O.noise(tiles(spark, d), 32, "simplex", (8.0, 20.0), octaves=2, seed=3, warp_amp=0.2).df))


def _image(spark, d) -> Grid:
    p = pixels(spark, d)
    return p.with_df(p.df.where("x = 0 AND y = 0").withColumns({"z": F.lit(0), "x": F.lit(0), "y": F.lit(0)}))


query("tiling", f"WITH {_TILES} SELECT lat.z, lat.x, lat.y, lat.px, lat.py, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b, coalesce(p.a, 0) AS a FROM lat LEFT JOIN lift_pixels AS p ON p.x = 0 AND p.y = 0 AND p.px = (lat.x * 32 + lat.px + 27) % 32 AND p.py = (lat.y * 32 + lat.py + 29) % 32", PX)(
    lambda spark, d: O.tiling(_image(spark, d), tiles(spark, d), 32, offset=(5.0, 3.0)).df)
query("tiling_turned")(lambda spark, d: O.tiling(_image(spark, d), tiles(spark, d), 32, scale_px=20.0, rotation_deg=30.0).df)
query("place")(lambda spark, d: O.place(_image(spark, d), tiles(spark, d), 32, "contain", 0.75, 15.0).df)
query("warp")(lambda spark, d: O.warp(pixels(spark, d), 8.0, 3.0).df)
query("flow_smear")(lambda spark, d: O.flow_smear(pixels(spark, d), pixels(spark, d, "lift_overlay"), 4).df)
_op("crop", f"SELECT z, x, y, px - 4 AS px, py - 4 AS py, r, g, b, a FROM lift_pixels WHERE px BETWEEN 4 AND 27 AND py BETWEEN 4 AND 27", lambda p: O.crop(p, 4))
query("icon", "SELECT z, x, y, px - 8 AS px, py - 4 AS py, r, g, b, a FROM lift_pixels WHERE px BETWEEN 8 AND 19 AND py BETWEEN 4 AND 13", PX)(
    lambda spark, d: O.icon(pixels(spark, d), spark.createDataFrame([("pin", 8, 4, 12, 10)], "name string, x int, y int, width int, height int"), "pin").df)
