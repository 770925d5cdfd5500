"""Style expressions (nested JSON arrays) as columns. Numbers are doubles; an error in a filter drops the row.

Properties are columns of the feature row, by name, or, where the row has a variant column ``properties``, entries of that;
``None`` for a name that the row does not have. In a variant, ``has`` tells a null entry from one that is not there; of a
column, null means not there. Colours are structs of straight shares r, g, b, a.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mercator
from .arith import FUNCTIONS, apply, clamp
from .color import parse

_MATH = {"abs": "abs", "floor": "floor", "ceil": "ceil", "round": "round", "sqrt": "sqrt", "ln": "log", "log2": "log2", "log10": "log10", "sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "acos": "acos", "atan": "atan", "%": "mod", "^": "pow"}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _fold(f, args: list[Column]) -> Column:
    out = args[0]
    for a in args[1:]:
        out = f(out, a)
    return out


def _yes(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def compile_expression(e, columns: list[str], names: dict[str, Column] | None = None) -> Column:
    """The column of an expression over a feature row with ``columns``; ``zoom`` is the row's z."""
    names = names or {}
    sub = lambda x: compile_expression(x, columns, names)
    if not isinstance(e, list):
        return F.lit(float(e)) if isinstance(e, (int, float)) and not isinstance(e, bool) else F.lit(e)
    op, args = e[0], e[1:]
    if op == "literal":
        return F.array(*[sub(x) for x in args[0]]) if isinstance(args[0], list) else sub(args[0])
    if op == "get":
        return _property(args[0], columns)
    if op in ("has", "!has"):
        known = F.lit(False)
        if args[0] in columns:
            known = F.col(f"`{args[0]}`").isNotNull()
        elif VARIANT in columns:
            known = F.try_variant_get(VARIANT, f"$['{args[0]}']", "variant").isNotNull()
        return known if op == "has" else ~known
    if op == "zoom":
        return F.col("z").cast("double")
    if op == "heatmap-density":
        return names["heatmap-density"]
    if op == "geometry-type":
        shapes = (("polygons", "Polygon"), ("lines", "LineString"), ("points", "Point"))
        known = [F.when(F.size(c) > 0, name) for c, name in shapes if c in columns]
        return F.coalesce(*known, F.lit("Unknown"))
    if op == "to-color":
        return F.coalesce(*[to_color(sub(a)) for a in args])
    if op in ("rgb", "rgba"):
        alpha = clamp(sub(args[3]), 0, 1) if op == "rgba" else F.lit(1.0)
        return rgba(*[clamp(sub(a) / 255, 0, 1) for a in args[:3]], alpha)
    if op == "within":
        return _within(args[0])
    if op == "distance":
        return _distance(args[0])
    if op in _COMPARE and len(args) == 3:
        a, b = (_collated(sub(x), args[2][1]) for x in args[:2])
        return _COMPARE[op](a, b)
    if op == "let":
        for name, value in zip(args[:-1:2], args[1:-1:2]):
            names = names | {name: compile_expression(value, columns, names)}
        return compile_expression(args[-1], columns, names)
    if op == "var":
        return names[args[0]]
    if op in _COMPARE:
        return _COMPARE[op](sub(args[0]), sub(args[1]))
    if op in ("all", "any", "none"):
        parts = [_yes(sub(a)) for a in args] or [F.lit(op != "any")]
        return _fold(lambda a, b: a & b, parts) if op == "all" else (_fold(lambda a, b: a | b, parts) if op == "any" else ~_fold(lambda a, b: a | b, parts))
    if op == "!":
        return ~_yes(sub(args[0]))
    if op == "in":
        within = args[1][1] if isinstance(args[1], list) and args[1][0] == "literal" else args[1:]
        return sub(args[0]).isin([float(v) if isinstance(v, (int, float)) else v for v in within])
    if op == "case":
        out = sub(args[-1])
        for when, then in reversed(list(zip(args[:-1:2], args[1:-1:2]))):
            out = F.when(_yes(sub(when)), sub(then)).otherwise(out)
        return out
    if op == "match":
        out, value = sub(args[-1]), sub(args[0])
        for labels, then in reversed(list(zip(args[1:-1:2], args[2:-1:2]))):
            out = F.when(value.isin(labels if isinstance(labels, list) else [labels]), sub(then)).otherwise(out)
        return out
    if op == "coalesce":
        return F.coalesce(*[sub(a) for a in args])
    if op == "step":
        value, out = sub(args[0]), sub(args[1])
        for stop, then in zip(args[2::2], args[3::2]):
            out = F.when(value >= stop, sub(then)).otherwise(out)
        return out
    if op == "interpolate":
        return _interpolate(args[0], sub(args[1]), list(zip(args[2::2], args[3::2])), sub)
    if op == "typeof":
        return _type_of(sub(args[0]))
    if op in ("number", "string", "boolean"):
        # The first argument of that type.
        kinds = {"number": ("double", ("double", "int", "bigint", "float")), "string": ("string", ("string",)), "boolean": ("boolean", ("boolean",))}
        kind, known = kinds[op]
        return F.coalesce(*[F.when(F.typeof(sub(a)).isin(*known), sub(a).try_cast(kind)) for a in args])
    if op in ("+", "*", "min", "max"):
        f = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "min": F.least, "max": F.greatest}[op]
        return _fold(f, [sub(a) for a in args])
    if op == "-":
        return -sub(args[0]) if len(args) == 1 else sub(args[0]) - sub(args[1])
    if op == "/":
        return F.try_divide(sub(args[0]), sub(args[1]))
    if op in _MATH:
        name = _MATH[op]
        return apply(name, *[sub(a) for a in args[: FUNCTIONS[name][0]]])
    if op == "concat":
        return F.concat(*[F.coalesce(as_text(sub(a)), F.lit("")) if isinstance(a, list) else F.lit(str(a)) for a in args])
    if op in ("upcase", "downcase"):
        return (F.upper if op == "upcase" else F.lower)(sub(args[0]))
    if op == "length":
        return F.length(sub(args[0])).cast("double")
    if op == "slice":
        end = F.length(sub(args[0])) if len(args) < 3 else F.lit(args[2])
        return F.substring(sub(args[0]), F.lit(args[1] + 1), end - args[1])
    if op == "index-of":
        return (F.instr(sub(args[1]), args[0]) - 1).cast("double")
    if op == "to-number":
        return F.coalesce(*[F.expr("1").cast("double") * 0 + sub(a).try_cast("double") for a in args])
    if op == "to-string":
        return F.coalesce(as_text(sub(args[0])), F.lit(""))
    if op == "to-boolean":
        return _yes(sub(args[0]))
    raise ValueError(f"no expression {op!r}")


def as_text(c: Column) -> Column:
    """Numbers without a trailing .0."""
    return F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0$", "$1")


VARIANT = "properties"


def _property(name: str, columns: list[str]) -> Column:
    """A typed column, or a variant's entry: numbers as doubles where they are some, else text."""
    if name in columns:
        return F.col(f"`{name}`")
    return F.try_variant_get(VARIANT, f"$['{name}']", "string") if VARIANT in columns else F.lit(None)


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"), a.cast("double").alias("a"))


# The sixteen basic colour names, and transparent.
NAMED = {
    "aqua": "#00ffff", "black": "#000000", "blue": "#0000ff", "fuchsia": "#ff00ff", "gray": "#808080", "green": "#008000", "lime": "#00ff00", "maroon": "#800000", "navy": "#000080",
    "olive": "#808000", "purple": "#800080", "red": "#ff0000", "silver": "#c0c0c0", "teal": "#008080", "white": "#ffffff", "yellow": "#ffff00", "transparent": "#00000000",
}


def to_color(text: Column) -> Column:
    """``#rgb``, ``#rgba``, ``#rrggbb``, ``#rrggbbaa``, ``rgb(r, g, b)``, ``rgba(r, g, b, a)`` and basic names; null for other text."""
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    t = F.lower(F.trim(text.cast("string")))
    t = F.coalesce(named[t], t)
    short = F.regexp_replace(t, "^#([0-9a-f])([0-9a-f])([0-9a-f])([0-9a-f]?)$", "#$1$1$2$2$3$3$4$4")
    byte = lambda at: F.conv(F.substring(short, at, 2), 16, 10).cast("double") / 255
    hexed = rgba(byte(2), byte(4), byte(6), F.when(F.length(short) == 9, byte(8)).otherwise(1.0))
    parts = F.split(F.regexp_extract(t, r"^rgba?\(([^)]*)\)$", 1), r"\s*,\s*")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    spelt = rgba(*[clamp(number(i) / 255, 0, 1) for i in range(3)], clamp(F.coalesce(number(3), F.lit(1.0)), 0, 1))
    whole = F.size(parts).isin(3, 4) & number(0).isNotNull() & number(1).isNotNull() & number(2).isNotNull()
    return F.when(short.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), hexed).when(whole, spelt)


def _collated(text: Column, options: dict) -> Column:
    """Text as a collator compares it: with or without regard to case and accents."""
    suffix = "" if options.get("case-sensitive") else "_CI"
    suffix += "" if options.get("diacritic-sensitive") else "_AI"
    return F.collate(text, f"UNICODE{suffix}")


def _type_of(c: Column) -> Column:
    kind = F.typeof(c)
    return F.when(c.isNull(), "null").when(kind.isin("double", "int", "bigint", "float"), "number").when(kind.startswith("struct"), "color").when(kind.startswith("array"), "array").otherwise(kind)


def _place(p: Column) -> tuple[Column, Column]:
    """Degrees of a point in tile units."""
    n = F.pow(F.lit(2.0), "z")
    return mercator.longitude((F.col("x") + p["x"] / 4096) / n), mercator.latitude((F.col("y") + p["y"] / 4096) / n)


def _rings(geometry: dict) -> list[list[tuple[float, float]]]:
    c = geometry["coordinates"]
    return [r for polygon in (c if geometry["type"] == "MultiPolygon" else [c]) for r in polygon]


def _within(geometry: dict) -> Column:
    """Whether all points of the feature lie in a polygon given in degrees; features without points do not."""

    def inside(p: Column) -> Column:
        lon, lat = _place(p)
        odd = F.lit(0)
        for ring in _rings(geometry):
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                if ay != by:
                    crossing = lon < ax + (lat - ay) * ((bx - ax) / (by - ay))
                    odd = odd + F.when(((F.lit(ay) > lat) != (F.lit(by) > lat)) & crossing, 1).otherwise(0)
        return odd % 2 == 1

    return (F.size("points") > 0) & F.forall("points", inside)


def _distance(geometry: dict) -> Column:
    """Metres from the feature's nearest point to the nearest of a geometry's vertices, on a sphere."""
    deep = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}[geometry["type"]]
    places = [geometry["coordinates"]] if not deep else geometry["coordinates"]
    for _ in range(deep - 1):
        places = [p for part in places for p in part]

    def metres(p: Column) -> Column:
        lon, lat = _place(p)
        out = []
        for x, y in places:
            half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2))
            h = half(lat - y) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(float(y)))) * half(lon - x)
            out.append(2 * mercator.EARTH_M / 6.283185307179586 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))
        return F.least(*out) if len(out) > 1 else out[0]

    return F.array_min(F.transform("points", metres))


def _eased(kind: list, t: Column) -> Column:
    """The height of a cubic curve from (0, 0) to (1, 1) at ``t``: the curve's parameter is found by halving."""
    x1, y1, x2, y2 = (float(v) for v in kind[1:])
    curve = lambda a, b, u: 3 * a * u * (1 - u) * (1 - u) + 3 * b * u * u * (1 - u) + u * u * u
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = curve(x1, x2, mid) < t
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda s: curve(y1, y2, (s["lo"] + s["hi"]) / 2))


def _is_color(e) -> bool:
    if isinstance(e, str):
        return e.startswith(("#", "rgb")) or e in NAMED
    return isinstance(e, list) and e[0] in ("rgb", "rgba", "to-color")


def _interpolate(kind: list, value: Column, stops: list, sub) -> Column:
    if kind[0] not in ("linear", "exponential", "cubic-bezier"):
        raise ValueError(f"no interpolation {kind[0]!r}")
    base = float(kind[1]) if kind[0] == "exponential" else 1.0
    colored = _is_color(stops[0][1])
    at = lambda e: to_color(F.lit(e)) if isinstance(e, str) and colored else sub(e)

    def between(a: Column, b: Column, t: Column) -> Column:
        if not colored:
            return a + (b - a) * t
        # Colours mix premultiplied.
        alpha = a["a"] + (b["a"] - a["a"]) * t
        mixed = [F.coalesce(F.try_divide(a[c] * a["a"] + (b[c] * b["a"] - a[c] * a["a"]) * t, alpha), F.lit(0.0)) for c in "rgb"]
        return rgba(*mixed, alpha)

    out = at(stops[0][1])
    for (a, va), (b, vb) in zip(stops[:-1], stops[1:]):
        t = (value - a) / (b - a) if base == 1.0 else (F.pow(F.lit(base), value - a) - 1) / (base ** (b - a) - 1)
        t = _eased(kind, t) if kind[0] == "cubic-bezier" else t
        out = F.when(value >= a, between(at(va), at(vb), t)).otherwise(out)
    return F.when(value >= stops[-1][0], at(stops[-1][1])).otherwise(out)


def compile_color(e, columns: list[str], names: dict[str, Column] | None = None) -> Column:
    """An expression that is a colour: text it gives is read as one."""
    if isinstance(e, str):
        r, g, b, a = parse(NAMED.get(e, e)) if not e.startswith("rgb") else (None,) * 4
        return to_color(F.lit(e)) if r is None else rgba(*[F.lit(v) for v in (r, g, b, a)])
    if e[0] in ("interpolate", "rgb", "rgba", "to-color"):
        return compile_expression(e, columns, names)
    return to_color(compile_expression(e, columns, names))


def switch(value: Column, cases: list[tuple], default: Column | None = None) -> Column:
    """The result of the first case whose label equals ``value``, else ``default``; null equals nothing."""
    out = default if default is not None else F.lit(None)
    for label, result in reversed(cases):
        labels = label if isinstance(label, (list, tuple)) else [label]
        out = F.when(value.isin(*labels), result).otherwise(out)
    return out


LEGACY = ("==", "!=", "<", "<=", ">", ">=")


def modern_filter(e):
    """A filter in the older form, whose operands are names of properties, as an expression; expressions stay as they are."""
    if not isinstance(e, list) or not e:
        return e
    op, args = e[0], e[1:]
    name = lambda k: ["geometry-type"] if k == "$type" else ["id"] if k == "$id" else ["get", k]
    if op in ("all", "any", "none"):
        return [op, *[modern_filter(a) for a in args]]
    if op in LEGACY and len(args) == 2 and isinstance(args[0], str) and not isinstance(args[1], list):
        return [op, name(args[0]), args[1]]
    if op in ("in", "!in") and args and isinstance(args[0], str) and not (len(args) == 2 and isinstance(args[1], list)):
        inside = ["in", name(args[0]), ["literal", list(args[1:])]]
        return inside if op == "in" else ["!", inside]
    return e


def compile_filter(e, columns: list[str]) -> Column:
    """A filter, in either form: what fails or is null does not pass."""
    return _yes(compile_expression(modern_filter(e), columns))
