"""Colours as columns: unpremultiplied shares of 1, hues in degrees, CIE L*a*b* under D65."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arith import clamp, to_byte

RGB = ("r", "g", "b")


def parse(text: str) -> tuple[float, float, float, float]:
    """``#rgb``, ``#rrggbb`` or ``#rrggbbaa`` as shares of 1."""
    h = text.lstrip("#")
    h = "".join(c * 2 for c in h) if len(h) in (3, 4) else h
    if len(h) not in (6, 8):
        raise ValueError(f"not a colour: {text}")
    v = [int(h[i : i + 2], 16) / 255 for i in range(0, len(h), 2)]
    return (*v[:3], v[3] if len(v) == 4 else 1.0)


def straight(*names: str) -> list[Column]:
    """The unpremultiplied channels of a pixel row as shares of 1; 0 where it is transparent."""
    return [F.when(F.col("a") > 0, F.col(c) / F.col("a")).otherwise(F.lit(0.0)) for c in names or RGB]


def premultiplied(channels: list[Column], alpha: Column) -> list[Column]:
    """r, g, b bytes out of straight shares and an alpha share."""
    return [to_byte(c * alpha).alias(n) for n, c in zip(RGB, channels)]


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


# sRGB primaries and the D65 white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)


def with_hsl(df: DataFrame, rgb: list[Column], p: str = "") -> DataFrame:
    """``df`` with hue (degrees), saturation and lightness as columns p_h, p_s, p_l; built in steps, so that no step repeats another."""
    df = df.withColumns({f"{p}_{n}": c for n, c in zip(RGB, rgb)})
    r, g, b = (F.col(f"{p}_{n}") for n in RGB)
    df = df.withColumns({f"{p}_hi": F.greatest(r, g, b), f"{p}_lo": F.least(r, g, b)})
    high, low = F.col(f"{p}_hi"), F.col(f"{p}_lo")
    d, l = high - low, (high + low) / 2
    grey = d < 1e-6
    s = F.when(grey, 0.0).when(l > 0.5, F.try_divide(d, 2 - high - low)).otherwise(F.try_divide(d, high + low))
    turn = F.try_divide(g - b, d)
    h = F.when(high == r, turn - 6 * F.floor(turn / 6)).when(high == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4)
    return df.withColumns({f"{p}_h": F.when(grey, 0.0).otherwise(h * 60), f"{p}_s": s, f"{p}_l": l})


def with_rgb_of_hsl(df: DataFrame, h: Column, s: Column, l: Column) -> tuple[DataFrame, list[Column]]:
    df = df.withColumns({"_hh": h / 60, "_ss": s, "_ll": l})
    df = df.withColumn("_cc", (1 - F.abs(2 * F.col("_ll") - 1)) * F.col("_ss"))
    c, sector, l = F.col("_cc"), F.col("_hh"), F.col("_ll")
    df = df.withColumn("_xx", c * (1 - F.abs(sector - 2 * F.floor(sector / 2) - 1)))
    x, at, zero = F.col("_xx"), F.floor(sector), F.lit(0.0)
    pick = lambda *v: F.when(at == 0, v[0]).when(at == 1, v[1]).when(at == 2, v[2]).when(at == 3, v[3]).when(at == 4, v[4]).otherwise(v[5])
    return df, [clamp(v + l - c / 2, 0, 1) for v in (pick(c, x, zero, zero, x, c), pick(x, c, c, x, zero, zero), pick(zero, zero, x, c, c, x))]


def with_lab(df: DataFrame, rgb: list[Column], p: str = "") -> DataFrame:
    """``df`` with L*a*b* as columns p_L, p_A, p_B."""
    df = df.withColumns({f"{p}_{n}": c for n, c in zip(RGB, rgb)})
    df = df.withColumns({f"{p}_lin_{n}": F.when(F.col(f"{p}_{n}") <= 0.04045, F.col(f"{p}_{n}") / 12.92).otherwise(F.pow((F.col(f"{p}_{n}") + 0.055) / 1.055, F.lit(2.4))) for n in RGB})
    linear = [F.col(f"{p}_lin_{n}") for n in RGB]
    df = df.withColumns({f"{p}_t{n}": sum((k * c for k, c in zip(row[1:], linear[1:])), row[0] * linear[0]) / w for n, row, w in zip("xyz", TO_XYZ, WHITE)})
    df = df.withColumns({f"{p}_f{n}": F.when(F.col(f"{p}_t{n}") > 216 / 24389, F.cbrt(f"{p}_t{n}")).otherwise((24389 / 27 * F.col(f"{p}_t{n}") + 16) / 116) for n in "xyz"})
    fx, fy, fz = (F.col(f"{p}_f{n}") for n in "xyz")
    return df.withColumns({f"{p}_L": 116 * fy - 16, f"{p}_A": 500 * (fx - fy), f"{p}_B": 200 * (fy - fz)})


def with_rgb_of_lab(df: DataFrame, l: Column, a: Column, b: Column) -> tuple[DataFrame, list[Column]]:
    df = df.withColumns({"_L1": l, "_A1": a, "_B1": b})
    fy = (F.col("_L1") + 16) / 116
    df = df.withColumns({"_gx": fy + F.col("_A1") / 500, "_gy": fy, "_gz": fy - F.col("_B1") / 200})
    cube = lambda c: c * c * c
    df = df.withColumns({f"_v{n}": F.when(cube(F.col(f"_g{n}")) > 216 / 24389, cube(F.col(f"_g{n}"))).otherwise((116 * F.col(f"_g{n}") - 16) / (24389 / 27)) * w for n, w in zip("xyz", WHITE)})
    xyz = [F.col(f"_v{n}") for n in "xyz"]
    df = df.withColumns({f"_o{n}": sum((k * v for k, v in zip(row[1:], xyz[1:])), row[0] * xyz[0]) for n, row in zip(RGB, FROM_XYZ)})
    back = lambda c: clamp(F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055), 0, 1)
    return df, [back(F.col(f"_o{n}")) for n in RGB]


def lab_of(rgb: tuple[float, ...]) -> tuple[float, float, float]:
    """L*a*b* of a plain colour, for palettes known when a plan is built."""
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in rgb[:3]]
    t = [sum(k * c for k, c in zip(row, linear)) / w for row, w in zip(TO_XYZ, WHITE)]
    f = [v ** (1 / 3) if v > 216 / 24389 else (24389 / 27 * v + 16) / 116 for v in t]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def lerp(a: list[Column], b: list[Column], t) -> list[Column]:
    return [x + (y - x) * t for x, y in zip(a, b)]
