"""Map styles (JSON layers) to operator plans: each layer becomes a raster, or labels, over the tiles that its source has.

Paint properties may be constants, expressions or the older functions of zoom (``stops``); expressions see a feature's
columns and its tile's zoom. Layers show from ``minzoom`` up to, not including, ``maxzoom``. Sizes are pixels of a tile of
512. What has no counterpart here (heights of extrusions, patterns, glyphs) is left out and listed by ``unsupported``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compile_color, compile_expression, compile_filter
from ..operators import coverage, geometry, labels, raster
from ..operators import field as fields
from ..operators.grid import TILE, Grid

V = F.col
STYLE_TILE = 512
IGNORED = {"fill-extrusion-height", "fill-extrusion-base", "fill-pattern", "line-pattern", "background-pattern", "line-gradient", "icon-image", "line-blur", "circle-blur"}


@dataclass
class Context:
    """What a layer needs: features or fields by source (``source`` or ``source.layer``), the tiles, their size in pixels."""

    sources: dict[str, DataFrame | Grid]
    tiles: DataFrame
    size: int
    unsupported: list[str] = field(default_factory=list)

    @property
    def pixel(self) -> float:
        return self.size / STYLE_TILE


def from_stops(e):
    """The older form of functions: {"stops": [[zoom, value], ...], "base": b, "property": name}."""
    if not isinstance(e, dict) or "stops" not in e:
        return e
    value = ["get", e["property"]] if "property" in e else ["zoom"]
    stops = [x for pair in e["stops"] for x in pair]
    if e.get("type") == "interval" or isinstance(e["stops"][0][1], (bool, str)) and not str(e["stops"][0][1]).startswith("#"):
        return ["step", value, e["stops"][0][1], *stops[2:]]
    return ["interpolate", ["exponential", e.get("base", 1)], value, *stops]


class Layer:
    """A style layer with its properties as columns over one frame of features."""

    def __init__(self, spec: dict, columns: list[str], k: float):
        self.spec, self.columns, self.k = spec, columns, k
        self.values = {n: from_stops(v) for part in ("paint", "layout") for n, v in spec.get(part, {}).items()}

    def constant(self, name: str, default):
        v = self.values.get(name, default)
        if isinstance(v, list) and v and isinstance(v[0], str):
            raise ValueError(f"{name} of layer {self.spec['id']} must be constant")
        return v

    def number(self, name: str, default: float, pixels: bool = False) -> Column:
        v = self.values.get(name, default)
        out = compile_expression(v, self.columns).cast("double") if isinstance(v, list) else F.lit(float(v))
        # An expression without a value for a feature gives the default.
        return F.coalesce(out, F.lit(float(default))) * (self.k if pixels else 1.0)

    def color(self, name: str, default: str) -> Column:
        return F.coalesce(compile_color(self.values.get(name, default), self.columns), compile_color(default, self.columns))


def _shown(rows: DataFrame, spec: dict) -> DataFrame:
    rows = rows.where(V("z") >= spec["minzoom"]) if "minzoom" in spec else rows
    return rows.where(V("z") < spec["maxzoom"]) if "maxzoom" in spec else rows


def _source(spec: dict, c: Context):
    name = spec["source"] + (f".{spec['source-layer']}" if "source-layer" in spec else "")
    if name not in c.sources:
        raise ValueError(f"layer {spec['id']}: no source {name}")
    return c.sources[name]


def _features(spec: dict, c: Context) -> tuple[DataFrame, Layer]:
    rows = _shown(_source(spec, c), spec)
    if "filter" in spec:
        rows = rows.where(compile_filter(spec["filter"], rows.columns))
    return rows, Layer(spec, rows.columns, c.pixel)


def _faded(grid: Grid, opacity: float) -> Grid:
    return grid if opacity >= 1 else raster.adjust(grid, opacity=opacity)


def background(spec: dict, c: Context) -> Grid:
    tiles = _shown(c.tiles, spec)
    layer = Layer(spec, tiles.columns, c.pixel)
    return _faded(raster.solid(tiles, c.size, layer.constant("background-color", "#000000")), layer.constant("background-opacity", 1))


def fill(spec: dict, c: Context) -> Grid:
    rows, layer = _features(spec, c)
    name = spec["type"]
    edge = layer.color("fill-outline-color", "#000000") if "fill-outline-color" in layer.values else None
    opacity = layer.number(f"{name}-opacity", 1)
    return coverage.fill_solid(rows, c.size, layer.color(f"{name}-color", "#000000"), opacity, edge, F.lit(c.pixel), opacity)


def line(spec: dict, c: Context) -> Grid:
    rows, layer = _features(spec, c)
    if "polygons" in rows.columns:
        rows = geometry.boundary(rows)
    dash = layer.constant("line-dasharray", None)
    if dash:
        width = layer.constant("line-width", 1) * c.pixel
        dash = (dash[0] * width, (dash[1] if len(dash) > 1 else dash[0]) * width)
    return coverage.stroke(
        rows,
        c.size,
        layer.color("line-color", "#000000"),
        layer.number("line-width", 1, pixels=True),
        layer.number("line-opacity", 1),
        layer.constant("line-cap", "butt"),
        layer.constant("line-join", "miter"),
        layer.constant("line-miter-limit", 2),
        dash,
    )


def circle(spec: dict, c: Context) -> Grid:
    rows, layer = _features(spec, c)
    return coverage.circles(
        rows,
        c.size,
        layer.number("circle-radius", 5, pixels=True),
        layer.color("circle-color", "#000000"),
        layer.number("circle-opacity", 1),
        layer.number("circle-stroke-width", 0, pixels=True),
        layer.color("circle-stroke-color", "#000000"),
        layer.number("circle-stroke-opacity", 1),
    )


# The colours of a heatmap without a colour property.
HEAT = ["interpolate", ["linear"], ["heatmap-density"], 0, "#0000ff00", 0.1, "#4169e1", 0.3, "#00ffff", 0.5, "#00ff00", 0.7, "#ffff00", 1, "#ff0000"]


def heatmap(spec: dict, c: Context) -> Grid:
    rows, layer = _features(spec, c)
    k = c.size / geometry.EXTENT
    rows = rows.withColumn("__w", layer.number("heatmap-weight", 1)).withColumn("p", F.explode("points"))
    rows = rows.select(*TILE, "__w", (V("p.x") * k).alias("fx"), (V("p.y") * k).alias("fy"))
    radius = layer.constant("heatmap-radius", 30) * c.pixel
    found = fields.density(rows, c.size, radius, V("__w"), layer.constant("heatmap-intensity", 1))
    ramp = layer.values.get("heatmap-color", HEAT)
    return fields.color_ramp(fields.map_range(found, 0, 1, 0, 1, clamped=True), list(zip(ramp[3::2], ramp[4::2])), opacity=layer.constant("heatmap-opacity", 1))


def _grid(spec: dict, c: Context) -> tuple[Grid, Layer]:
    grid = _source(spec, c)
    return grid.with_df(_shown(grid.df, spec)), Layer(spec, grid.df.columns, c.pixel)


def hillshade(spec: dict, c: Context) -> Grid:
    grid, layer = _grid(spec, c)
    return fields.hillshade(
        grid,
        azimuth=layer.constant("hillshade-illumination-direction", 335),
        exaggeration=layer.constant("hillshade-exaggeration", 0.5),
        mode="relief",
        shadow=layer.constant("hillshade-shadow-color", "#000000"),
        highlight=layer.constant("hillshade-highlight-color", "#ffffff"),
    )


def imagery(spec: dict, c: Context) -> Grid:
    grid, layer = _grid(spec, c)
    return raster.adjust(
        grid,
        layer.constant("raster-opacity", 1),
        layer.constant("raster-hue-rotate", 0),
        layer.constant("raster-saturation", 0),
        layer.constant("raster-contrast", 0),
        layer.constant("raster-brightness-min", 0),
        layer.constant("raster-brightness-max", 1),
    )


def symbol(spec: dict, c: Context) -> DataFrame:
    """Label candidates of the layer's points, for ``labels.label_placement``: glyphs have a fixed advance."""
    rows, layer = _features(spec, c)
    size = layer.number("text-size", 16)
    text = layer.values.get("text-field", "")
    # {name} in a plain text stands for a property.
    if isinstance(text, str) and "{" in text:
        parts = [x for i, x in enumerate(text.replace("}", "{").split("{")) if x or i % 2]
        text = ["concat", *[["get", x] if x in rows.columns else x for x in parts]]
    words = compile_expression(text, rows.columns) if isinstance(text, list) else F.lit(text)
    how = layer.constant("text-transform", "none")
    words = {"none": lambda t: t, "uppercase": F.upper, "lowercase": F.lower}[how](words)
    rows = rows.withColumns({"text": words, "sort_key": layer.number("symbol-sort-key", 0), "__s": size}).withColumn("p", F.explode("points"))
    rows = rows.withColumns({"vx": V("p.x"), "vy": V("p.y"), "cand_ix": V("feature_ix")}).drop("p", *[s for s in geometry.SHAPES if s in rows.columns])
    units = geometry.EXTENT / STYLE_TILE
    found = labels.text_labels(rows, V("text"), V("sort_key"))
    pad = layer.number("text-padding", 2)
    box = {"half_w": (F.length("text") * V("__s") / 4 + pad) * units, "half_h": (V("__s") / 2 + pad) * units}
    return found.withColumns(box).drop("__s")


LAYERS = {
    "background": background,
    "fill": fill,
    "fill-extrusion": fill,
    "line": line,
    "circle": circle,
    "heatmap": heatmap,
    "hillshade": hillshade,
    "raster": imagery,
    "symbol": symbol,
}


def translate(style: dict, c: Context) -> dict[str, Grid | DataFrame]:
    """Layer id -> its raster (labels for symbol layers), in the order drawn; hidden layers and unknown types are left out."""
    out = {}
    for spec in style["layers"]:
        if spec.get("layout", {}).get("visibility") == "none":
            continue
        make = LAYERS.get(spec["type"])
        if make is None:
            c.unsupported.append(f"{spec['id']}: type {spec['type']}")
            continue
        c.unsupported += [f"{spec['id']}: {n}" for part in ("paint", "layout") for n in spec.get(part, {}) if n in IGNORED]
        out[spec["id"]] = make(spec, c)
    return out


def render(style: dict, c: Context) -> Grid:
    """All rasters of a style laid over each other."""
    return raster.stack([g for g in translate(style, c).values() if isinstance(g, Grid)])


def place_symbols(style: dict, c: Context) -> DataFrame:
    """Candidates of all symbol layers placed together, later layers first."""
    found = None
    for i, rows in enumerate(d for d in translate(style, c).values() if isinstance(d, DataFrame)):
        own = rows.select(*TILE, F.lit(i).alias("layer_ix"), "cand_ix", "sort_key", "text", "wax", "way", "half_w", "half_h")
        found = own if found is None else found.unionByName(own)
    return labels.label_placement(found)


# Parameters of documents


def with_params(document, declared: dict[str, dict], values: dict | None = None):
    """A document with each ``"$name"`` replaced: numbers are kept within ``min`` and ``max``, other values must be allowed.

    A parameter that is not declared, of another type or outside its ``enum`` is an error.
    """
    values = values or {}
    if unknown := set(values) - set(declared):
        raise ValueError(f"not declared: {sorted(unknown)}")
    kinds = {"number": (int, float), "bool": (bool,), "color": (str,), "string": (str,)}

    def value(name: str):
        if name not in declared:
            raise ValueError(f"not declared: {name}")
        spec = declared[name]
        v = values.get(name, spec.get("default"))
        if not isinstance(v, kinds[spec["type"]]) or (spec["type"] == "number" and isinstance(v, bool)):
            raise ValueError(f"{name} must be a {spec['type']}")
        if "enum" in spec and v not in spec["enum"]:
            raise ValueError(f"{name} must be one of {spec['enum']}")
        return min(max(v, spec.get("min", v)), spec.get("max", v)) if spec["type"] == "number" else v

    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return value(x[1:]) if isinstance(x, str) and x.startswith("$") else x

    return walk(document)
