"""Features out of GeoJSON text, with JSON functions: one feature a row, coordinates as given or projected into tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.geometry import EXTENT, SHAPES, mapped, point

V = F.col
#: How deep geometry collections are opened.
DEPTH = 4
_DEEP = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def decode(texts: DataFrame, column: str = "json") -> DataFrame:
    """(other columns, feature_ix, id, properties variant, points, lines, polygons) of collections, features or geometries.

    Coordinates stay degrees. Rings lose the vertex that closes them. Ids that are no whole number are null, as are
    properties that are arrays or objects. Text that is no GeoJSON gives no row.
    """
    rest = [c for c in texts.columns if c != column]
    root = F.from_json(column, "type string, features array<string>, geometry string, coordinates string")
    rows = texts.withColumn("__root", root)
    one = F.when(V("__root.type") == "Feature", F.array(column)).otherwise(F.array(F.concat(F.lit('{"type":"Feature","geometry":'), column, F.lit("}"))))
    every = F.when(V("__root.type") == "FeatureCollection", V("__root.features")).when(V("__root.type").isNotNull(), one)
    rows = rows.select(*rest, F.posexplode(every).alias("feature_ix", "__feature"))
    parts = F.from_json("__feature", "id string, properties string, geometry string")
    rows = rows.select(*rest, V("feature_ix").cast("long").alias("feature_ix"), V("__feature"), parts.alias("__f"))
    # A number in quotes is a string, which is no id.
    number = F.when(~V("__feature").rlike(r'"id"\s*:\s*"'), F.try_to_number(V("__f.id"), F.lit("9" * 19)).cast("long"))
    rows = rows.select(*rest, "feature_ix", number.alias("id"), F.try_parse_json("__f.properties").alias("properties"), _geometries(V("__f.geometry")).alias("__g"))
    return rows.select(*rest, "feature_ix", "id", "properties", *_shapes(V("__g")))


def _geometries(geometry: Column) -> Column:
    """array<struct<type, coordinates>> of a geometry, collections opened."""
    schema = "type string, coordinates string, geometries array<string>"
    found = F.array(F.from_json(geometry, schema))
    for _ in range(DEPTH):
        deeper = lambda g: F.when(g["type"] == "GeometryCollection", F.transform(g["geometries"], lambda t: F.from_json(t, schema))).otherwise(F.array(g))
        found = F.flatten(F.transform(F.filter(found, lambda g: g["type"].isNotNull()), deeper))
    return F.coalesce(found, F.array().cast("array<struct<type:string,coordinates:string,geometries:array<string>>>"))


def _read(g: Column, kind: str) -> Column:
    nested = "double"
    for _ in range(_DEEP[kind]):
        nested = f"array<{nested}>"
    return F.from_json(F.concat(F.lit('{"c":'), g["coordinates"], F.lit("}")), f"c {nested}")["c"]


def _place(p: Column) -> Column:
    return point(F.coalesce(F.get(p, F.lit(0)), F.lit(0.0)), F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)))


def _unclosed(ring: Column) -> Column:
    closed = (F.size(ring) >= 2) & (ring[0] == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)


def _chosen(ways: dict, empty: Column):
    def own(g: Column) -> Column:
        out = empty
        for kind, way in ways.items():
            out = F.when(g["type"] == kind, F.coalesce(way(_read(g, kind)), empty)).otherwise(out)
        return out

    return own


def _shapes(geometries: Column) -> list[Column]:
    line = lambda c: F.transform(c, _place)
    polygon = lambda c: F.transform(c, lambda r: F.transform(F.array(F.transform(r, _place)), _unclosed)[0])
    ways = {
        "points": {"Point": lambda c: F.array(_place(c)), "MultiPoint": line},
        "lines": {"LineString": lambda c: F.array(line(c)), "MultiLineString": lambda c: F.transform(c, line)},
        "polygons": {"Polygon": lambda c: F.array(polygon(c)), "MultiPolygon": lambda c: F.transform(c, polygon)},
    }
    out = []
    for name, kinds in ways.items():
        empty = F.array().cast(SHAPES[name])

        out.append(F.flatten(F.transform(geometries, _chosen(kinds, empty))).alias(name))
    return out


def prop(name: str, kind: str = "string") -> Column:
    """A property of decoded features as a typed column; arrays and objects are null."""
    value = F.try_variant_get("properties", f"$['{name}']", "variant")
    flat = ~F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)")
    return F.when(flat, F.try_variant_get("properties", f"$['{name}']", kind))


def world(p: Column) -> Column:
    """Degrees to the unit square, y down; latitudes stop short of the poles."""
    s = F.least(F.greatest(F.sin(F.radians(p["y"])), F.lit(-0.999999)), F.lit(0.999999))
    return point((p["x"] + 180) / 360, 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi))


def tiled(features: DataFrame, z: int, buffer: float = 64.0, extent: int = EXTENT) -> DataFrame:
    """Features in degrees bound to the tiles at ``z`` that their boxes touch, within ``buffer`` units, in whole tile units.

    Coordinates outside the tile are kept. A feature is exploded to its tiles, so one that covers very many has many rows.
    What lies in no tile has no sequence of them: a filter would be moved below and work out the shapes again.
    """
    n = 1 << z
    rows = mapped(features, world)
    every = F.concat(V("points"), F.flatten("lines"), F.flatten(F.flatten("polygons")))
    rows = rows.withColumn("__v", every)
    edge = buffer / extent
    low = lambda k: F.greatest(F.floor(F.array_min(F.transform("__v", lambda p: p[k])) * n - edge), F.lit(0)).cast("int")
    high = lambda k: F.least(F.floor(F.array_max(F.transform("__v", lambda p: p[k])) * n + edge), F.lit(n - 1)).cast("int")
    rows = rows.withColumns({"__x0": low("x"), "__x1": high("x"), "__y0": low("y"), "__y1": high("y")})
    span = lambda k: F.when(V(f"__{k}0") <= V(f"__{k}1"), F.sequence(f"__{k}0", f"__{k}1"))
    rows = rows.withColumn("x", F.explode(span("x"))).withColumn("y", F.explode(span("y")))
    rows = mapped(rows, lambda p: point(F.round((p["x"] * n - V("x")) * extent), F.round((p["y"] * n - V("y")) * extent)))
    rest = [c for c in features.columns if c not in SHAPES]
    return rows.select(F.lit(z).alias("z"), "x", "y", *rest, *SHAPES)
