"""Which tiles a job covers, the frame of a printed page, pixels of ancestors where tiles are missing, and writing pyramids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mercator import EARTH_M, MAX_LATITUDE
from ..operators.grid import PIXEL, TILE, Grid

V = F.col
METRES_PER_INCH = 0.0254
#: The sizes that a frame's tiles may have, and its deepest zoom of its own choice.
SMALLEST, LARGEST, DEEPEST = 16, 8192, 24


def _world(lon: float, lat: float) -> tuple[float, float]:
    lat = min(max(lat, -MAX_LATITUDE), MAX_LATITUDE)
    return (lon + 180) / 360, (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2


def tile_range(z: int, box: tuple[float, float, float, float] | None = None) -> tuple[int, int, int, int]:
    """First and last column and row (x0, x1, y0, y1) of the tiles that meet (west, south, east, north); no box, the world."""
    n = 1 << z
    if box is None:
        return 0, n - 1, 0, n - 1
    west, south, east, north = box
    (x0, y0), (x1, y1) = _world(west, north), _world(east, south)
    cell = lambda v: min(max(math.floor(v * n), 0), n - 1)
    return cell(x0), cell(x1), cell(y0), cell(y1)


def enumerate_tiles(spark: SparkSession, min_zoom: int, max_zoom: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(z, x, y) of all tiles from ``min_zoom`` to ``max_zoom`` that meet the box: made in tasks, never on the driver."""
    if min_zoom > max_zoom:
        raise ValueError("min_zoom must not be above max_zoom")
    out = None
    for z in range(min_zoom, max_zoom + 1):
        x0, x1, y0, y1 = tile_range(z, box)
        wide = x1 - x0 + 1
        cells = spark.range(wide * (y1 - y0 + 1))
        x, y = (V("id") % wide + x0).cast("int"), (F.floor(V("id") / wide) + y0).cast("int")
        rows = cells.select(F.lit(z).alias("z"), x.alias("x"), y.alias("y"))
        out = rows if out is None else out.unionAll(rows)
    return out


@dataclass(frozen=True)
class Frame:
    """A page of ``width`` by ``height`` pixels on the world's pixel grid at one zoom and tile size."""

    zoom: int
    tile_size: int
    scale: float
    width: int
    height: int
    left: int
    top: int

    @property
    def tiles(self) -> tuple[range, range]:
        n = 1 << self.zoom
        span = lambda start, length: range(*(min(max(v, 0), n) for v in (start // self.tile_size, -(-(start + length) // self.tile_size))))
        return span(self.left, self.width), span(self.top, self.height)

    def placed(self, spark: SparkSession) -> DataFrame:
        """(z, x, y, dx, dy): the page's tiles and where their corners lie on it."""
        xs, ys = self.tiles
        rows = spark.range(xs.start, xs.stop).select(V("id").cast("int").alias("x"))
        rows = rows.withColumn("y", F.explode(F.array(*[F.lit(y) for y in ys]))) if len(ys) else rows.where("false").withColumn("y", F.lit(0))
        offset = lambda c, start: (V(c).cast("long") * self.tile_size - start)
        return rows.select(F.lit(self.zoom).alias("z"), "x", "y", offset("x", self.left).alias("dx"), offset("y", self.top).alias("dy"))

    def pixels(self, tiles: Grid) -> DataFrame:
        """(fx, fy, bands): the pixels of tiles at their places on the page; what lies outside is cut off."""
        fx, fy = (V(t).cast("long") * self.tile_size + V(p) - start for t, p, start in (("x", "px", self.left), ("y", "py", self.top)))
        rows = tiles.df.where(V("z") == self.zoom).select(fx.alias("fx"), fy.alias("fy"), *tiles.bands)
        return rows.where(V("fx").between(0, self.width - 1) & V("fy").between(0, self.height - 1))


def metres_per_pixel(lat: float, tile_size: float, zoom: int) -> float:
    return EARTH_M * math.cos(math.radians(lat)) / (tile_size * 2**zoom)


def frame(lon: float, lat: float, scale: float, dpi: float, width: int, height: int, zoom: int | None = None, style_tile_size: int = 512) -> Frame:
    """The frame for a scale on paper; without a zoom, that whose tile size is nearest the style's, by ratio (ties: the lower)."""
    if not (scale > 0 and dpi > 0 and width > 0 and height > 0 and -180 <= lon <= 180 and abs(lat) <= MAX_LATITUDE):
        raise ValueError("scale, resolution and size must be positive, the centre on the map")
    wanted = scale * METRES_PER_INCH / dpi
    exact = lambda z: metres_per_pixel(lat, 1.0, z) / wanted
    if zoom is None:
        zoom = min(range(DEEPEST + 1), key=lambda z: (abs(math.log(exact(z) / style_tile_size)), z))
    size = math.floor(exact(zoom) + 0.5)
    if not SMALLEST <= size <= LARGEST:
        raise ValueError(f"a tile size of {exact(zoom):.1f} at zoom {zoom} is outside {SMALLEST} to {LARGEST}")
    half_up = lambda v: math.floor(v + 0.5) if v >= 0 else -math.floor(0.5 - v)
    wx, wy = (c * size * 2**zoom for c in _world(lon, lat))
    left, top = half_up(wx - width / 2), half_up(wy - height / 2)
    if left < 0 or left + width > size * 2**zoom:
        raise ValueError("the frame crosses the antimeridian")
    return Frame(zoom, size, metres_per_pixel(lat, size, zoom) * dpi / METRES_PER_INCH, width, height, left, top)


def on_missing(wanted: DataFrame, grid: Grid, policy: str = "overzoom", levels: int = 4) -> Grid:
    """Pixels of the wanted tiles. A tile without any takes its nearest ancestor's, enlarged, up to ``levels`` up.

    ``policy``: overzoom; skip (such tiles stay away); error (they raise when the plan runs). Ancestors are looked up by
    joins of tiles; pixels are read once and dealt to the tiles that use them.
    """
    known = grid.df.select(*TILE).distinct()
    if policy == "skip":
        return grid.with_df(grid.df.join(wanted.select(*TILE).distinct(), list(TILE), "left_semi"))
    up = wanted.select(*TILE).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(0 if policy == "error" else levels)))).where("k <= z")
    source = up.withColumns({"sz": V("z") - V("k"), "sx": F.expr("shiftright(x, k)"), "sy": F.expr("shiftright(y, k)")})
    there = known.select(V("z").alias("sz"), V("x").alias("sx"), V("y").alias("sy"))
    nearest = source.join(there, ["sz", "sx", "sy"]).groupBy(*TILE).agg(F.min("k").alias("k"))
    if policy == "error":
        found = wanted.select(*TILE).distinct().join(nearest, list(TILE), "left")
        fail = F.raise_error(F.concat_ws("/", F.lit("no tile"), "z", "x", "y")).cast("int")
        nearest = found.withColumn("k", F.coalesce("k", fail))
    use = nearest.withColumns({"sz": V("z") - V("k"), "sx": F.expr("shiftright(x, k)"), "sy": F.expr("shiftright(y, k)"), "n": F.expr("shiftleft(1, k)")})
    pixels = grid.df.select(V("z").alias("sz"), V("x").alias("sx"), V("y").alias("sy"), V("px").alias("qx"), V("py").alias("qy"), *grid.bands)
    rows = use.join(pixels, ["sz", "sx", "sy"])
    # Pixels of a tile that an ancestor's pixel covers.
    first = lambda q, t, s, size: F.ceil((V(q) * V("n")) - (V(t) - V(s) * V("n")) * size).cast("int")
    rows = rows.withColumns({"x0": first("qx", "x", "sx", grid.width), "y0": first("qy", "y", "sy", grid.height)})
    inside = lambda c, size: (V(c) > -V("n")) & (V(c) < size)
    rows = rows.where(inside("x0", grid.width) & inside("y0", grid.height))
    span = lambda c: F.sequence(V(c), V(c) + V("n") - 1)
    rows = rows.withColumn("px", F.explode(span("x0"))).withColumn("py", F.explode(span("y0")))
    rows = rows.where(V("px").between(0, grid.width - 1) & V("py").between(0, grid.height - 1))
    return grid.with_df(rows.select(*PIXEL, *grid.bands))


def stitch_window(grid: Grid, pad: int, nodata: float | None = None) -> Grid:
    """Each tile with ``pad`` pixels of its neighbours around it; x wraps, beyond the poles there is nothing.

    A pixel is dealt to the tiles whose margins it lies in: at most four for margins below half a tile. ``nodata`` samples
    become missing.
    """
    if pad > min(grid.width, grid.height):
        raise ValueError("a margin wider than a tile needs more than the eight neighbours")
    reach = lambda p, size: F.filter(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: (V(p) - d * size >= -pad) & (V(p) - d * size < size + pad))
    n = F.expr("shiftleft(1, z)")
    rows = grid.df if nodata is None else grid.df.withColumn("v", F.when(V("v") != nodata, V("v")))
    rows = rows.withColumn("dx", F.explode(reach("px", grid.width))).withColumn("dy", F.explode(reach("py", grid.height)))
    rows = rows.withColumns({"px": V("px") - V("dx") * grid.width + pad, "py": V("py") - V("dy") * grid.height + pad})
    rows = rows.withColumns({"x": F.pmod(V("x") + V("dx"), n), "y": V("y") + V("dy")}).where((V("y") >= 0) & (V("y") < n))
    own = grid.df.select(*TILE).distinct()
    # A world of one or two columns meets itself on both sides.
    rows = rows.join(own, list(TILE), "left_semi").select(*PIXEL, *grid.bands).dropDuplicates(list(PIXEL))
    return Grid(rows, grid.width + 2 * pad, grid.height + 2 * pad, grid.pitch)


def upsample(field: Grid, factor: int) -> Grid:
    """``factor`` times as many samples a side, each between its four nearest by distance; known ones alone count.

    Every sample is exploded to the finer samples it takes part in and summed with map-side combine: no join.
    """
    k = int(factor)
    # Finer sample i lies at (i + 0.5) / k - 0.5 of the coarse lattice.
    near = lambda p, size: F.sequence(F.greatest((V(p) - 1) * k, F.lit(0)), F.least((V(p) + 2) * k - 1, F.lit(size * k - 1)))
    rows = field.df.where("v IS NOT NULL").withColumn("fx", F.explode(near("px", field.width))).withColumn("fy", F.explode(near("py", field.height)))

    def share(p: str, f: str, size: int):
        at = F.least(F.greatest((V(f) + 0.5) / k - 0.5, F.lit(0.0)), F.lit(float(size - 1)))
        return F.greatest(1 - F.abs(at - V(p)), F.lit(0.0))

    rows = rows.withColumn("w", share("px", "fx", field.width) * share("py", "fy", field.height)).where("w > 0")
    out = rows.groupBy(*TILE, V("fx").alias("px"), V("fy").alias("py")).agg((F.sum(V("v") * V("w")) / F.sum("w")).alias("v"))
    return Grid(out, field.width * k, field.height * k, field.pitch / k)


def write_pyramid(grid: Grid, path: str, mode: str = "overwrite") -> None:
    """Pixel rows as Parquet in folders z=/x=, tiles whole and in order within files, so that a reader prunes to its tiles."""
    rows = grid.df.repartition(*TILE).sortWithinPartitions(*TILE, "py", "px")
    rows.write.mode(mode).partitionBy("z", "x").parquet(path)


def read_pyramid(spark: SparkSession, path: str, width: int, height: int, tiles: DataFrame | None = None) -> Grid:
    """A written pyramid, or the ``tiles`` of it."""
    df = spark.read.parquet(path)
    df = df.select(*PIXEL, *[c for c in df.columns if c not in PIXEL])
    return Grid(df if tiles is None else df.join(tiles.select(*TILE).distinct(), list(TILE), "left_semi"), width, height)
