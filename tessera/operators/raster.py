"""Operators on rasters: premultiplied bytes per pixel. Colour arithmetic works on straight (unpremultiplied) shares."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.arith import clamp, to_byte
from .grid import BANDS, NEAR, PIXEL, TILE, Grid, dense, lattice, neighbourhoods, per_tile

V = F.col


def _recolored(raster: Grid, channels: list[Column], alpha: Column | None = None, df: DataFrame | None = None) -> Grid:
    """Opaque parts with new straight channels; ``alpha`` (share) is kept unless given. Transparent pixels stay so."""
    share = V("a") / 255 if alpha is None else alpha
    seen = [F.when(V("a") > 0, c).otherwise(0).alias(n) for n, c in zip("rgb", [to_byte(c * share) for c in channels])]
    own = V("a") if alpha is None else F.when(V("a") > 0, to_byte(alpha)).otherwise(0)
    return raster.with_df((raster.df if df is None else df).select(*PIXEL, *seen, own.alias("a")))


def _unit(*names: str) -> list[Column]:
    return [F.least(c, F.lit(1.0)) for c in color.straight(*names)]


# One pixel at a time


def invert(raster: Grid) -> Grid:
    return raster.select(**{c: V("a") - V(c) for c in "rgb"}, a=V("a"))


def brightness_contrast(raster: Grid, brightness: float = 0.0, contrast: float = 0.0) -> Grid:
    return _recolored(raster, [clamp((c - 0.5) * (1 + contrast) + 0.5 + brightness, 0, 1) for c in color.straight()])


def posterize(raster: Grid, steps: float) -> Grid:
    n = max(2, min(256, math.floor(steps + 0.5))) - 1
    return _recolored(raster, [clamp(F.round(c * n) / n, 0, 1) for c in color.straight()])


def levels(raster: Grid, in_black: float = 0.0, in_white: float = 1.0, gamma: float = 1.0, out_black: float = 0.0, out_white: float = 1.0) -> Grid:
    power = 1.0 if abs(gamma) < 1e-6 else 1 / gamma
    curve = lambda c: clamp(F.pow(clamp((c - in_black) / max(in_white - in_black, 1e-6), 0, 1), F.lit(power)) * (out_white - out_black) + out_black, 0, 1)
    return _recolored(raster, [curve(c) for c in color.straight()])


def color_to_alpha(raster: Grid, key: str, threshold: float = 0.0, softness: float = 0.0) -> Grid:
    """Distance to a colour (largest channel difference) becomes coverage."""
    target, low = color.parse(key), max(threshold, 0.0)
    high = max(low + softness, low + 1e-6)
    rgb = color.straight()
    d = F.greatest(*[F.abs(c - t) for c, t in zip(rgb, target)])
    cover = F.when(d <= low, 0.0).when(d >= high, 1.0).otherwise((d - low) / (high - low))
    return _recolored(raster, rgb, V("a") / 255 * cover)


def _sources() -> dict[str, Column]:
    r, g, b = color.straight()
    return {"r": r, "g": g, "b": b, "a": V("a") / 255, "luminance": color.luma(r, g, b), "0": F.lit(0.0), "1": F.lit(1.0)}


def channel_shuffle(raster: Grid, r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> Grid:
    """Each output channel from a straight input channel, luminance, 0 or 1; premultiplied by the new alpha."""
    s = _sources()
    alpha = clamp(s[a], 0, 1)
    return raster.with_df(raster.df.select(*PIXEL, *[to_byte(clamp(s[k], 0, 1) * alpha).alias(n) for n, k in zip("rgb", (r, g, b))], to_byte(alpha).alias("a")))


def pick_channel(raster: Grid, channel: str = "luminance") -> Grid:
    """One channel as a field; blank pixels are 0, nothing is missing."""
    return raster.select(v=clamp(_sources()[channel], 0, 1))


def _toward(v: Column, amount: float) -> Column:
    t = min(max(amount, -1.0), 1.0)
    return v + (1 - v) * t if t >= 0 else v + v * t


def hsl(raster: Grid, hue_shift: float = 0.0, saturation: float = 0.0, lightness: float = 0.0) -> Grid:
    df = color.with_hsl(raster.df, _unit())
    h = V("_h") + hue_shift
    df, rgb = color.with_rgb_of_hsl(df, h - 360 * F.floor(h / 360), _toward(V("_s"), saturation), _toward(V("_l"), lightness))
    return _recolored(raster, rgb, df=df)


def saturate(raster: Grid, amount: float = 1.0) -> Grid:
    k = max(amount, 0.0)
    df, rgb = color.with_rgb_of_lab(color.with_lab(raster.df, _unit()), V("_L"), V("_A") * k, V("_B") * k)
    return _recolored(raster, rgb, df=df)


def vibrance(raster: Grid, amount: float = 0.0) -> Grid:
    """Saturates dull colours more than strong ones; chroma 100 counts as full."""
    chroma = F.sqrt(V("_A") * V("_A") + V("_B") * V("_B"))
    df = color.with_lab(raster.df, _unit()).withColumn("_k", F.greatest(1 + amount * (1 - clamp(chroma / 100, 0, 1)), F.lit(0.0)))
    df, rgb = color.with_rgb_of_lab(df, V("_L"), V("_A") * V("_k"), V("_B") * V("_k"))
    return _recolored(raster, rgb, df=df)


def _nearest(df: DataFrame, rgb: list[Column], palette: list[str], space: str) -> tuple[DataFrame, list[Column]]:
    """The palette colour at the least squared distance; the first of equals."""
    if space == "rgb":
        df = df.withColumns({"_L": rgb[0], "_A": rgb[1], "_B": rgb[2]})
    else:
        df = color.with_lab(df, rgb)
    best = []
    for i, name in enumerate(palette):
        c = color.parse(name)[:3]
        to = c if space == "rgb" else color.lab_of(c)
        d = [V(n) - q for n, q in zip(("_L", "_A", "_B"), to)]
        best.append(F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d"), F.lit(i).alias("i"), *[F.lit(x).alias(n) for x, n in zip(c, "rgb")]))
    df = df.withColumn("_best", F.array_min(F.array(*best)))
    return df, [V(f"_best.{n}") for n in "rgb"]


def quantize(raster: Grid, palette: list[str], space: str = "lab") -> Grid:
    df, rgb = _nearest(raster.df, color.straight(), palette, space)
    return _recolored(raster, rgb, df=df)


# The 4 x 4 ordered-dither matrix.
BAYER = ((0, 8, 2, 10), (12, 4, 14, 6), (3, 11, 1, 9), (15, 7, 13, 5))


def dither(raster: Grid, palette: list[str], method: str = "ordered", amount: float = 1.0, space: str = "rgb") -> Grid:
    """Ordered: a bias by place, then the nearest colour. Floyd-Steinberg: the error spreads 7, 3, 5, 1 of 16 onward."""
    if method == "ordered":
        flat = F.array(*[F.lit(v) for row in BAYER for v in row])
        bias = ((flat[F.pmod(V("py"), F.lit(4)) * 4 + F.pmod(V("px"), F.lit(4))] + 0.5) / 16 - 0.5) * min(max(amount, 0), 1)
        df, rgb = _nearest(raster.df, [clamp(c + bias, 0, 1) for c in color.straight()], palette, space)
        return _recolored(raster, rgb, df=df)
    if space != "rgb":
        raise ValueError("error diffusion compares in rgb")
    import numpy as np

    colors = np.array([color.parse(p)[:3] for p in palette])

    def diffuse(planes, key):
        a = planes["a"]
        rgb = np.stack([planes[c] for c in "rgb"], 2) / np.where(a > 0, a, 1)[..., None]
        out, (h, w) = np.zeros_like(rgb), a.shape
        for y in range(h):
            for x in range(w):
                if a[y, x] <= 0:
                    continue
                old = np.clip(rgb[y, x], 0, 1)
                out[y, x] = colors[((old - colors) ** 2).sum(1).argmin()]
                for dy, dx, k in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        rgb[y + dy, x + dx] += (old - out[y, x]) * k / 16
        found = np.floor(out * a[..., None] + 0.5).astype(int)
        return {c: found[..., i] for i, c in enumerate("rgb")} | {"a": a.astype(int)}

    return raster.with_df(per_tile(raster, diffuse, "r int, g int, b int, a int"))


def adjust(raster: Grid, opacity: float = 1.0, hue_rotate_deg: float = 0.0, saturation: float = 0.0, contrast: float = 0.0, brightness_min: float = 0.0, brightness_max: float = 1.0) -> Grid:
    """Paint adjustments of imagery: hue rotation, saturation, contrast, brightness range, opacity, in this order."""
    t = math.radians(hue_rotate_deg)
    w = [(2 * math.cos(t) + 1) / 3, (-math.sqrt(3) * math.sin(t) - math.cos(t) + 1) / 3, (math.sqrt(3) * math.sin(t) - math.cos(t) + 1) / 3]
    r, g, b = color.straight()
    rgb = [r * w[0] + g * w[1] + b * w[2], r * w[2] + g * w[0] + b * w[1], r * w[1] + g * w[2] + b * w[0]]
    mean = (rgb[0] + rgb[1] + rgb[2]) / 3
    sat = 1 - 1 / (1.001 - saturation) if saturation > 0 else -saturation
    con = 1 / (1 - min(contrast, 0.999999)) if contrast > 0 else 1 + contrast
    rgb = [(c + (mean - c) * sat - 0.5) * con + 0.5 for c in rgb]
    rgb = [clamp(brightness_min + (brightness_max - brightness_min) * c, 0, 1) for c in rgb]
    return _recolored(raster, rgb, V("a") / 255 * min(max(opacity, 0), 1))


# Two rasters


def _pair(a: Grid, b: Grid, mask: Grid | None = None) -> DataFrame:
    """Both rasters' bands as b_* and s_*; a pixel that only one has meets a transparent one."""
    if (a.width, a.height) != (b.width, b.height):
        raise ValueError("rasters differ in size")
    df = a.df.select(*PIXEL, *[V(c).alias(f"b_{c}") for c in BANDS]).join(b.df.select(*PIXEL, *[V(c).alias(f"s_{c}") for c in BANDS]), list(PIXEL), "full")
    if mask is not None:
        df = df.join(mask.df.select(*PIXEL, V("a").alias("m_a")), list(PIXEL), "left")
    return df.fillna(0, [c for c in df.columns if c not in PIXEL])


def _mode(mode: str, b: Column, s: Column) -> Column:
    hard = lambda b, s: F.when(s <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s))
    soft = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return {
        "normal": lambda: s, "multiply": lambda: b * s, "screen": lambda: b + s - b * s, "overlay": lambda: hard(s, b),
        "darken": lambda: F.least(b, s), "lighten": lambda: F.greatest(b, s), "hard-light": lambda: hard(b, s),
        "color-dodge": lambda: F.when(b <= 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(F.try_divide(b, 1 - s), F.lit(1.0))),
        "color-burn": lambda: F.when(b >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.try_divide(1 - b, s), F.lit(1.0))),
        "soft-light": lambda: F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (soft - b)),
        "difference": lambda: F.abs(b - s), "exclusion": lambda: b + s - 2 * b * s,
    }[mode]()


def _weight(c: list[Column]) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def _with_weight(c: list[Column], l: Column) -> list[Column]:
    d = l - _weight(c)
    c = [x + d for x in c]
    low, high, l = F.least(*c), F.greatest(*c), _weight(c)
    c = [F.when(low < 0, l + F.try_divide((x - l) * l, l - low)).otherwise(x) for x in c]
    return [F.when(high > 1, l + F.try_divide((x - l) * (1 - l), high - l)).otherwise(x) for x in c]


def _with_spread(c: list[Column], s: Column) -> list[Column]:
    low, high = F.least(*c), F.greatest(*c)
    return [F.when(high > low, (x - low) * s / (high - low)).otherwise(0.0) for x in c]


def _whole_mode(mode: str, b: list[Column], s: list[Column]) -> list[Column]:
    spread = lambda c: F.greatest(*c) - F.least(*c)
    return {
        "hue": lambda: _with_weight(_with_spread(s, spread(b)), _weight(b)),
        "saturation": lambda: _with_weight(_with_spread(b, spread(s)), _weight(b)),
        "color": lambda: _with_weight(s, _weight(b)),
        "luminosity": lambda: _with_weight(b, _weight(s)),
    }[mode]()


#: Porter-Duff operators: the shares of source and base that stay, out of the other's alpha.
COMPOSITES = {
    "clear": (lambda o: 0 * o, lambda o: 0 * o), "source": (lambda o: 1 + 0 * o, lambda o: 0 * o),
    "destination": (lambda o: 0 * o, lambda o: 1 + 0 * o), "source-over": (lambda o: 1 + 0 * o, lambda o: 1 - o),
    "destination-over": (lambda o: 1 - o, lambda o: 1 + 0 * o), "source-in": (lambda o: o, lambda o: 0 * o),
    "destination-in": (lambda o: 0 * o, lambda o: o), "source-out": (lambda o: 1 - o, lambda o: 0 * o),
    "destination-out": (lambda o: 0 * o, lambda o: 1 - o), "source-atop": (lambda o: o, lambda o: 1 - o),
    "destination-atop": (lambda o: 1 - o, lambda o: o), "xor": (lambda o: 1 - o, lambda o: 1 - o),
}
WHOLE_MODES = ("hue", "saturation", "color", "luminosity")


def _div255(x: Column) -> Column:
    t = x + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def blend(base: Grid, over: Grid, mode: str = "normal", composite: str = "source-over", opacity: float = 1.0, mask: Grid | None = None) -> Grid:
    """Blend two rasters; plain source-over without a mask is exact in whole numbers, all else is rounded at the end."""
    op, df = min(max(opacity, 0.0), 1.0), _pair(base, over, mask)
    if mode == "normal" and composite == "source-over" and mask is None and op >= 1:
        return base.with_df(df.select(*PIXEL, *[(V(f"s_{c}") + _div255(V(f"b_{c}") * (255 - V("s_a")))).alias(c) for c in BANDS]))
    share = V("s_a") / 255 * op * (V("m_a") / 255 if mask is not None else 1.0)
    ba = V("b_a") / 255
    un = lambda p: [F.when(V(f"{p}_a") > 0, V(f"{p}_{c}") / V(f"{p}_a")).otherwise(0.0) for c in "rgb"]
    b, s = un("b"), un("s")
    mixed = _whole_mode(mode, b, s) if mode in WHOLE_MODES else [_mode(mode, x, y) for x, y in zip(b, s)]
    s = [(1 - ba) * y + ba * m for y, m in zip(s, mixed)]
    fs, fb = (f(x) for f, x in zip(COMPOSITES[composite], (ba, share)))
    out = [to_byte(share * fs * y + ba * fb * x).alias(n) for n, x, y in zip("rgb", b, s)]
    return base.with_df(df.select(*PIXEL, *out, to_byte(share * fs + ba * fb).alias("a")))


def stack(layers: list[Grid]) -> Grid:
    """Source-over of layers in their order, in whole numbers. Blank pixels need no row: one grouping folds all layers."""
    first = layers[0]
    if any((g.width, g.height) != (first.width, first.height) for g in layers):
        raise ValueError("layers differ in size")
    rows = None
    for i, g in enumerate(layers):
        own = g.df.where("a > 0").select(*PIXEL, F.lit(i).alias("layer"), *BANDS)
        rows = own if rows is None else rows.unionAll(own)
    folded = rows.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("layer", *BANDS))).alias("all"))  # one per layer at most
    blank = F.struct(*[F.lit(0).alias(c) for c in BANDS])
    out = F.aggregate("all", blank, lambda d, s: F.struct(*[(s[c] + _div255(d[c] * (255 - s["a"]))).cast("int").alias(c) for c in BANDS]))
    return first.with_df(folded.select(*PIXEL, out.alias("o")).select(*PIXEL, "o.*"))


def mix(a: Grid, b: Grid, t: float, space: str = "rgb") -> Grid:
    """Between two rasters; in rgb premultiplied values are mixed, elsewhere straight colours."""
    df, t = _pair(a, b), min(max(t, 0.0), 1.0)
    if space == "rgb":
        return a.with_df(df.select(*PIXEL, *[F.round(V(f"b_{c}") + (V(f"s_{c}") - V(f"b_{c}")) * t).cast("int").alias(c) for c in BANDS]))
    un = lambda p: [F.when(V(f"{p}_a") > 0, F.least(V(f"{p}_{c}") / V(f"{p}_a"), F.lit(1.0))).otherwise(0.0) for c in "rgb"]
    alpha = (V("b_a") + (V("s_a") - V("b_a")) * t) / 255
    if space == "lab":
        df = color.with_lab(color.with_lab(df, un("b"), "one"), un("s"), "two")
        df, rgb = color.with_rgb_of_lab(df, *color.lerp(*[[V(f"{p}_{n}") for n in "LAB"] for p in ("one", "two")], t))
    elif space == "hsl":  # hues go the short way round
        df = color.with_hsl(color.with_hsl(df, un("b"), "one"), un("s"), "two")
        gap = V("two_h") - V("one_h")
        h = V("one_h") + (gap - 360 * F.round(gap / 360)) * t
        df, rgb = color.with_rgb_of_hsl(df, h - 360 * F.floor(h / 360), *color.lerp(*[[V(f"{p}_{n}") for n in "sl"] for p in ("one", "two")], t))
    else:
        raise ValueError(f"no colour space {space!r}")
    return a.with_df(df.select(*PIXEL, *color.premultiplied(rgb, alpha), to_byte(alpha).alias("a")))


def _taps(source: Grid, at: DataFrame, boundary: str) -> DataFrame:
    """Bilinear samples of ``source`` at (sx, sy) for each pixel row of ``at``: four taps, weighted and summed.

    A tile's pixels are put in one list, which is joined by tile; taps are looked up there by place. Rows are never made more of.
    """
    w, h, bands = source.width, source.height, source.bands
    own = F.struct((V("py") * w + V("px")).alias("own"), *bands)
    tiles = dense(source).df.groupBy(*TILE).agg(F.sort_array(F.collect_list(own)).alias("all"))
    rows = at.select(*PIXEL, "sx", "sy").join(tiles, list(TILE), "left")
    share = lambda s, i: V(s) - F.floor(s) if i else 1 - (V(s) - F.floor(s))

    def tap(i: int, j: int) -> Column:
        qx, qy = (_bounded((F.floor(s) + k).cast("long"), n, boundary) for s, k, n in (("sx", i, w), ("sy", j, h)))
        return F.when(qx.between(0, w - 1) & qy.between(0, h - 1), F.get("all", qy * w + qx))

    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    rows = rows.select(*PIXEL, *[(share("sx", i) * share("sy", j)).alias(f"k{i}{j}") for i, j in corners], *[tap(i, j).alias(f"t{i}{j}") for i, j in corners])
    total = lambda part: functools.reduce(operator.add, [part(V(f"k{i}{j}"), V(f"t{i}{j}")) for i, j in corners])
    if bands == ("v",):
        known = total(lambda k, t: F.when(t["v"].isNotNull(), k).otherwise(0.0))
        return rows.select(*PIXEL, F.when(known > 0, total(lambda k, t: F.when(t["v"].isNotNull(), k * t["v"]).otherwise(0.0)) / known).alias("v"))
    return rows.select(*PIXEL, *[F.round(F.round(total(lambda k, t: k * F.coalesce(t[c], F.lit(0))), 9)).cast("int").alias(c) for c in bands])


def _bounded(q: Column, n: int, boundary: str) -> Column:
    if boundary == "clamp":
        return F.least(F.greatest(q, F.lit(0)), F.lit(n - 1)).cast("int")
    if boundary == "wrap":
        return F.pmod(q, F.lit(n)).cast("int")
    if boundary == "mirror":
        m = F.pmod(q, F.lit(2 * n))
        return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int")
    return q.cast("int")  # transparent: no pixel out there


def displace(source: Grid, by: Grid, amp_x: float, amp_y: float | None = None, boundary: str = "clamp") -> Grid:
    """Each pixel from where the displacement raster's r and g send it; 0.5 stays."""
    amp_y = amp_x if amp_y is None else amp_y
    at = dense(by).df.select(*PIXEL, (V("px") + (V("r") / 255 - 0.5) * 2 * amp_x).alias("sx"), (V("py") + (V("g") / 255 - 0.5) * 2 * amp_y).alias("sy"))
    return source.with_df(_taps(source, at, boundary))


def tiling(source: Grid, tiles: DataFrame, size: int, scale_px: float | None = None, rotation_deg: float = 0.0, offset: tuple[float, float] = (0.0, 0.0), anchor: str = "world", opacity: float = 1.0) -> Grid:
    """One image (tile 0/0/0 of ``source``) repeated over every tile, bilinear around its edges."""
    scale = source.width if scale_px is None else max(scale_px, 0.5)
    t = -math.radians(rotation_deg)
    rows = lattice(tiles, size, size)
    cx, cy = (V(p) - o + (V(w) * size if anchor == "world" else 0) for p, w, o in (("px", "x", offset[0]), ("py", "y", offset[1])))
    rx, ry = (cx * math.cos(t) - cy * math.sin(t), cx * math.sin(t) + cy * math.cos(t)) if abs(rotation_deg) > 1e-9 else (cx, cy)
    at = rows.select(*PIXEL, (rx * (source.width / scale)).alias("sx"), (ry * (source.height / scale)).alias("sy"))
    image = Grid(at.select(*TILE).distinct().crossJoin(F.broadcast(source.df.select("px", "py", *BANDS))), source.width, source.height)  # one image
    out = Grid(_taps(image, at, "wrap"), size, size)
    return out if opacity >= 1 else out.select(**{c: F.round(V(c) * opacity).cast("int") for c in BANDS})


def place(source: Grid, tiles: DataFrame, size: int, fit: str = "contain", scale: float = 1.0, rotation_deg: float = 0.0, position: tuple[float, float] | None = None, opacity: float = 1.0) -> Grid:
    """One image (tile 0/0/0) put once on each tile, centred or at ``position``."""
    kx, ky = size / source.width, size / source.height
    kx, ky = {"none": (1.0, 1.0), "contain": (min(kx, ky),) * 2, "cover": (max(kx, ky),) * 2, "stretch": (kx, ky)}[fit]
    t, (ox, oy) = -math.radians(rotation_deg), position or (size / 2, size / 2)
    dx, dy = V("px") + 0.5 - ox, V("py") + 0.5 - oy
    sx = (dx * math.cos(t) - dy * math.sin(t)) / (kx * scale) + source.width / 2 - 0.5
    sy = (dx * math.sin(t) + dy * math.cos(t)) / (ky * scale) + source.height / 2 - 0.5
    at = lattice(tiles, size, size).select(*PIXEL, F.round(sx, 9).alias("sx"), F.round(sy, 9).alias("sy"))
    at = at.where((V("sx") > -1) & (V("sx") < source.width) & (V("sy") > -1) & (V("sy") < source.height))
    image = Grid(at.select(*TILE).distinct().crossJoin(F.broadcast(source.df.select("px", "py", *BANDS))), source.width, source.height)  # one image
    return Grid(_taps(image, at, "transparent"), size, size).select(**{c: F.round(V(c) * opacity).cast("int") for c in BANDS})


# Neighbourhoods


def _window(axis: str, before: int, after: int):
    return Window.partitionBy(*TILE, "py" if axis == "px" else "px").orderBy(axis).rangeBetween(-before, after)


def _morphology(grid: Grid, radius: float, best) -> Grid:
    """Square window cut at the edge, along rows and then columns; missing samples are skipped."""
    r = min(max(int(math.floor(radius + 0.5)), 0), 256)
    df = dense(grid).df
    for axis in ("px", "py"):
        df = df.select(*PIXEL, *[best(c).over(_window(axis, r, r)).alias(c) for c in grid.bands])
    return grid.with_df(df)


def erode(grid: Grid, radius: float) -> Grid:
    return _morphology(grid, radius, F.min)


def dilate(grid: Grid, radius: float) -> Grid:
    return _morphology(grid, radius, F.max)


def blur(grid: Grid, sigma: float) -> Grid:
    """Separable Gaussian of radius ceil(3 sigma); edges repeat. Missing samples are skipped and weights made up for.

    Along each axis a pixel is exploded to those it reaches, in its own task, and these sum what reaches them. At an edge it
    also stands for all that lies beyond: it reaches a pixel with the sum of the kernel from there on.
    """
    if sigma <= 0:
        return grid
    r = math.ceil(3 * sigma)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(r + 1)]
    total = kernel[0] + 2 * sum(kernel[1:])
    near = F.array(*[F.lit(k / total) for k in kernel])
    beyond = F.array(*[F.lit(sum(kernel[i:]) / total) for i in range(r + 1)])
    df, own = dense(grid).df, "v" in grid.bands
    for axis, size in (("px", grid.width), ("py", grid.height)):
        reached = F.sequence(F.greatest(V(axis) - r, F.lit(0)), F.least(V(axis) + r, F.lit(size - 1)))
        far = F.abs(V("t") - V(axis))
        last = (V(axis) == 0) & (V("t") >= V(axis)) | (V(axis) == size - 1) & (V("t") <= V(axis))
        w = F.when(last, beyond[far]).otherwise(near[far]) if size > 1 else F.lit(1.0)
        rows = df.withColumn("t", F.explode(reached)).withColumn("w", w).drop(axis).withColumnRenamed("t", axis).groupBy(*PIXEL)
        if own:
            df = rows.agg((F.sum(V("w") * V("v")) / F.sum(F.when(V("v").isNotNull(), V("w")))).alias("v"))
        else:
            df = rows.agg(*[F.sum(V("w") * V(c)).alias(c) for c in BANDS])
    g = grid.with_df(df)
    return g if own else g.select(**{c: F.round(F.round(V(c), 9)).cast("int") for c in BANDS})


def _cut(x: Column) -> Column:
    return F.floor(clamp(x, 0, 255)).cast("int")


def sharpen(grid: Grid, amount: float = 1.0) -> Grid:
    """c (1 + 4k) - k (n + s + e + w). Rasters: all four bands, cut to bytes; fields: a missing neighbour is the centre."""
    out = {}
    for band in grid.bands:
        c = V(f"{band}_c")
        near = [F.coalesce(V(f"{band}_{k}"), c) for k in ("n", "s", "e", "w")]
        v = c * (1 + 4 * amount) - amount * (near[0] + near[1] + near[2] + near[3])
        out[band] = v if band == "v" else _cut(v)
    return grid.with_df(neighbourhoods(grid)).select(**out)


def edge_detect(raster: Grid, strength: float = 1.0) -> Grid:
    """Size of the 3 x 3 weighted slopes per band, cut to bytes."""
    out = {}
    for band in BANDS:
        nw, n, ne, w, _, e, sw, s, se = (V(f"{band}_{k}") for k in NEAR)
        gx = (ne + 2 * e + se) - (nw + 2 * w + sw)
        gy = (sw + 2 * s + se) - (nw + 2 * n + ne)
        out[band] = _cut(F.sqrt((gx * gx + gy * gy).cast("double")) * strength)
    return raster.with_df(neighbourhoods(raster)).select(**out)


def mosaic(raster: Grid, block: float, mode: str = "average", anchor: str = "world") -> Grid:
    """Blocks of one colour: the truncated mean of each band, or the block's middle pixel."""
    b = max(1, math.floor(block + 0.5))
    if b == 1:
        return raster
    g = dense(raster)
    at = lambda p, w, size: V(p) + (V(w) * size if anchor == "world" else 0)
    df = g.df.withColumns({"bx": F.floor(at("px", "x", g.width) / b), "by": F.floor(at("py", "y", g.height) / b)})
    block_of = Window.partitionBy(*TILE, "bx", "by")
    if mode == "average":
        one = {c: F.floor(F.sum(c).over(block_of) / F.count(c).over(block_of)).cast("int") for c in BANDS}
    else:
        middle = (at("px", "x", g.width) - V("bx") * b == b // 2) & (at("py", "y", g.height) - V("by") * b == b // 2)
        one = {c: F.max(F.when(middle, V(c))).over(block_of) for c in BANDS}
    return raster.with_df(df.select(*PIXEL, *[F.coalesce(v, F.lit(0)).alias(c) for c, v in one.items()]))


# Generators


def solid(tiles: DataFrame, size: int, fill: str | float) -> Grid:
    rows = lattice(tiles, size, size)
    if not isinstance(fill, str):
        return Grid(rows.withColumn("v", F.lit(float(fill))), size, size)
    c = color.parse(fill)
    return Grid(rows.select(*PIXEL, *_painted([F.lit(x) for x in c[:3]], F.lit(c[3]))), size, size)


def _painted(rgb: list[Column], alpha: Column) -> list[Column]:
    return [*color.premultiplied(rgb, alpha), to_byte(alpha).alias("a")]


def circle(tiles: DataFrame, size: int, radius_frac: float, hardness: float = 1.0, fill: str | None = None) -> Grid:
    """A disk in the middle of each tile: full up to the hard part, then linear to the rim."""
    r = size * radius_frac
    inner = r * min(max(hardness, 0.0), 0.999)
    d = F.sqrt(F.pow(V("px") + 0.5 - size / 2, F.lit(2)) + F.pow(V("py") + 0.5 - size / 2, F.lit(2)))
    cover = F.when(d <= inner, 1.0).when(d >= r, 0.0).otherwise(1 - (d - inner) / (r - inner))
    rows = lattice(tiles, size, size)
    if fill is None:
        return Grid(rows.withColumn("v", cover), size, size)
    c = color.parse(fill)
    return Grid(rows.select(*PIXEL, *_painted([F.lit(x) for x in c[:3]], c[3] * cover)), size, size)


def gradient(tiles: DataFrame, size: int, kind: str, stops: list[tuple[float, str]] | None = None, start: tuple[float, float] = (0.0, 0.0), end: tuple[float, float] = (1.0, 0.0), center: tuple[float, float] = (0.5, 0.5), radius: float = 0.5, aspect: float = 1.0, start_angle_deg: float = 0.0, anchor: str = "tile", interpolation: str = "linear") -> Grid:
    """linear, radial, conic or diamond over each tile (shares of a tile) or the world (shares of the unit square).

    Without stops the position itself, clamped to [0, 1], as a field.
    """
    ux, uy = ((V(p) + 0.5) / size for p in ("px", "py"))
    if anchor == "world":
        n = F.pow(F.lit(2.0), V("z"))
        ux, uy = (V("x") + ux) / n, (V("y") + uy) / n
    dx, dy = ux - center[0], uy - center[1]
    if kind == "linear":
        vx, vy = end[0] - start[0], end[1] - start[1]
        length = vx * vx + vy * vy
        t = ((ux - start[0]) * vx + (uy - start[1]) * vy) / length if length > 0 else F.lit(-1.0)
    elif kind == "radial":
        t = F.sqrt(F.pow(dx / aspect, F.lit(2)) + dy * dy) / radius
    elif kind == "diamond":
        t = (F.abs(dx) + F.abs(dy)) / radius
    else:
        turn = (F.atan2(dy, dx) - math.radians(start_angle_deg)) / (2 * math.pi)
        t = turn - F.floor(turn)
    rows = lattice(tiles, size, size)
    if stops is None:
        return Grid(rows.withColumn("v", clamp(t, 0, 1)), size, size)
    from .field import ramp

    r, g, b, a = ramp(V("t"), stops, interpolation)
    return Grid(rows.withColumn("t", t).select(*PIXEL, *_painted([r, g, b], a)), size, size)


def cell_hash(*parts: Column, salt: int = 0) -> Column:
    """A whole number below 2^31 out of non-negative whole numbers, by arithmetic that every SQL engine shares."""
    h = F.lit(salt % 2147483647).cast("long")
    for p in parts:
        h = (h * 48271 + p.cast("long") % 2147483647 * 69621 + 12345) % 2147483647
        h = (h * 16807 + F.floor(h / 65536).cast("long")) % 2147483647
    return h


def noise(
    tiles: DataFrame,
    size: int,
    kind: str = "white",
    scale_px: float | tuple[float, float] = 16.0,
    octaves: int = 1,
    gain: float = 0.5,
    lacunarity: float = 2.0,
    seed: int = 0,
    anchor: str = "world",
    warp_amp: float = 0.0,
    warp_freq: float = 1.0,
) -> Grid:
    """Raw noise within [-1, 1]; ``scale_px`` may differ along x and y.

    white: a number per pixel; cell and worley: number and nearness (1 at it, -1 a cell away) of the nearest of jittered
    cell points; value: smooth between lattice numbers; perlin and simplex: sums of slopes around the corners of squares and
    triangles. Octaves are averaged by their amplitudes. ``warp_amp`` (in wavelengths) moves places by two other noises.
    """
    rows = with_noise(lattice(tiles, size, size), "v", size, kind, scale_px, octaves, gain, lacunarity, seed, anchor, warp_amp, warp_freq)
    return Grid(rows, size, size)


def with_noise(rows: DataFrame, name: str, size: int, kind: str, scale_px: float | tuple[float, float], octaves: int, gain: float, lacunarity: float, seed: int, anchor: str, warp_amp: float = 0.0, warp_freq: float = 1.0) -> DataFrame:
    """Pixel rows with the noise at each as a column."""
    own = rows.columns
    wx, wy = (V(p) + (V(w) * size if anchor == "world" else 0) for p, w in (("px", "x"), ("py", "y")))
    if kind == "white":
        return rows.withColumn(name, cell_hash(wx, wy, salt=seed) / 2147483647 * 2 - 1)
    sx, sy = scale_px if isinstance(scale_px, tuple) else (scale_px, scale_px)
    u, v = wx / sx, wy / sy
    if warp_amp:
        rows = rows.withColumns({"wu": _lattice_noise(kind, u * warp_freq, v * warp_freq, seed + 1000), "wv": _lattice_noise(kind, u * warp_freq, v * warp_freq, seed + 2000)})
        u, v = u + warp_amp * V("wu"), v + warp_amp * V("wv")
    rows = rows.withColumns({"u": u, "v": v})
    total, top, k, f = F.lit(0.0), 0.0, 1.0, 1.0
    for o in range(max(1, octaves)):
        total = total + k * _lattice_noise(kind, V("u") * f, V("v") * f, seed + o)
        top, k, f = top + k, k * gain, f * lacunarity
    return rows.select(*own, clamp(total / top, -1, 1).alias(name))


def _lattice_noise(kind: str, u: Column, v: Column, seed: int) -> Column:
    if kind == "simplex":
        return _simplex(u, v, seed)
    i, j = F.floor(u), F.floor(v)
    fx, fy = u - i, v - j
    h = lambda dx, dy, s=0: _cell_number(i + dx, j + dy, seed * 4 + s)
    if kind in ("worley", "cell"):
        best = None
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                ex, ey = dx + h(dx, dy, 1) - fx, dy + h(dx, dy, 2) - fy
                here = F.struct(F.sqrt(ex * ex + ey * ey).alias("d"), h(dx, dy, 3).alias("n"))
                best = here if best is None else F.least(best, here)
        return 1 - 2 * F.least(best["d"], F.lit(1.0)) if kind == "worley" else best["n"] * 2 - 1
    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    sx, sy = fade(fx), fade(fy)
    if kind == "value":
        at = lambda dx, dy: h(dx, dy) * 2 - 1
    else:
        at = lambda dx, dy: _slope(h(dx, dy), fx - dx, fy - dy) * math.sqrt(2)
    low, high = (at(0, d) + (at(1, d) - at(0, d)) * sx for d in (0, 1))
    return low + (high - low) * sy


def _cell_number(i: Column, j: Column, salt: int) -> Column:
    """In [0, 1), of a cell anywhere on the plane."""
    return cell_hash(F.pmod(i, F.lit(2147483647)), F.pmod(j, F.lit(2147483647)), salt=salt) / 2147483647


def _slope(number: Column, dx: Column, dy: Column) -> Column:
    turn = number * (2 * math.pi)
    return F.cos(turn) * dx + F.sin(turn) * dy


def _simplex(u: Column, v: Column, seed: int) -> Column:
    """Slopes around the corners of the triangle a place lies in, each fading to nothing at the far side."""
    skew, back = (math.sqrt(3) - 1) / 2, (3 - math.sqrt(3)) / 6
    i, j = F.floor(u + (u + v) * skew), F.floor(v + (u + v) * skew)
    x0, y0 = u - (i - (i + j) * back), v - (j - (i + j) * back)
    first = F.when(x0 > y0, 1).otherwise(0)
    total = F.lit(0.0)
    for di, dj in ((F.lit(0), F.lit(0)), (first, 1 - first), (F.lit(1), F.lit(1))):
        dx, dy = x0 - di + (di + dj) * back, y0 - dj + (di + dj) * back
        fade = F.greatest(0.5 - dx * dx - dy * dy, F.lit(0.0))
        total = total + F.pow(fade, F.lit(4)) * _slope(_cell_number(i + di, j + dj, seed * 4), dx, dy)
    return total * 99.2  # brings the largest sum near 1


def warp(source: Grid, scale_px: float, amp_x: float, amp_y: float | None = None, octaves: int = 1, gain: float = 0.5, lacunarity: float = 2.0, seed: int = 0, anchor: str = "world", boundary: str = "clamp") -> Grid:
    """Displaced by two smooth noises, both made on the pixels where these are: a lattice is never joined or sent around."""
    amp_y, at = amp_x if amp_y is None else amp_y, dense(source).df.select(*PIXEL)
    for k, n in enumerate(("nx", "ny")):
        at = with_noise(at, n, source.width, "value", scale_px, octaves, gain, lacunarity, seed + 101 * k, anchor)
    at = at.select(*PIXEL, (V("px") + V("nx") * amp_x).alias("sx"), (V("py") + V("ny") * amp_y).alias("sy"))
    return source.with_df(_taps(source, at, boundary))


def flow_smear(source: Grid, flow: Grid, length_px: float = 8.0, sides: str = "both", taper: bool = False) -> Grid:
    """Mean along the flow (r, g as 0.5 + 0.5 * component), in steps of a pixel forward, backward or both."""
    import numpy as np

    joined = Grid(dense(source).df.join(dense(flow).df.select(*PIXEL, V("r").alias("fr"), V("g").alias("fg")), list(PIXEL)), source.width, source.height)
    steps = max(0, math.floor(length_px + 0.5))

    def smear(planes, key):
        h, w = planes["a"].shape
        vx, vy = (planes[c] / 255 * 2 - 1 for c in ("fr", "fg"))
        rgba = np.stack([planes[c] for c in BANDS], 2)
        total, weight = rgba.copy(), np.ones((h, w, 1))
        for sign in {"both": (1, -1), "forward": (1,), "backward": (-1,)}[sides]:
            y, x = np.mgrid[0:h, 0:w].astype(float)
            for s in range(1, steps + 1):
                iy, ix = (np.clip(np.floor(c + 0.5).astype(int), 0, n - 1) for c, n in ((y, h), (x, w)))
                x, y = x + sign * vx[iy, ix], y + sign * vy[iy, ix]
                iy, ix = (np.clip(np.floor(c + 0.5).astype(int), 0, n - 1) for c, n in ((y, h), (x, w)))
                k = 1 - s / (steps + 1) if taper else 1.0
                total += rgba[iy, ix] * k
                weight += k
        out = np.floor(total / weight + 0.5).astype(int)
        return {c: out[..., i] for i, c in enumerate(BANDS)}

    return source.with_df(per_tile(joined, smear, "r int, g int, b int, a int"))


def crop(raster: Grid, pad: int) -> Grid:
    """Without the padding around the tile."""
    inner = (V("px") >= pad) & (V("px") < raster.width - pad) & (V("py") >= pad) & (V("py") < raster.height - pad)
    df = raster.df.where(inner).withColumns({"px": V("px") - pad, "py": V("py") - pad})
    return Grid(df, raster.width - 2 * pad, raster.height - 2 * pad, raster.pitch)


def icon(atlas: Grid, index: DataFrame, name: str) -> Grid:
    """One named rectangle (name, x, y, width, height) of a sprite atlas; an unknown name is one transparent pixel."""
    r = index.where(V("name") == name).select("x", "y", "width", "height").first()
    if r is None:
        blank = lattice(atlas.df.select(*TILE).limit(1), 1, 1)
        return Grid(blank.select(*PIXEL, *[F.lit(0).alias(c) for c in BANDS]), 1, 1)
    inside = V("px").between(r.x, r.x + r.width - 1) & V("py").between(r.y, r.y + r.height - 1)
    return Grid(atlas.df.where(inside).withColumns({"px": V("px") - r.x, "py": V("py") - r.y}), r.width, r.height)
