"""Dense lattices of samples: fields (column v) and rasters (columns r, g, b, a; premultiplied bytes), one row per pixel.

Rows are keyed by tile (z, x, y) and pixel (px, py). A field's missing sample is a null; a raster's blank pixel may be
left out and counts as transparent. Everything that looks at neighbours first deals rows by tile once (see ``dense``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = ("z", "x", "y")
PIXEL = (*TILE, "px", "py")
BANDS = ("r", "g", "b", "a")
#: Fewest tasks for rows that are made far more of; no more than are written without a sort (spark.shuffle.sort.bypassMergeThreshold).
TASKS = 192


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    width: int
    height: int
    pitch: float = 1.0  # metres per pixel

    @property
    def bands(self) -> tuple[str, ...]:
        return tuple(c for c in self.df.columns if c not in PIXEL)

    def with_df(self, df: DataFrame) -> Grid:
        return replace(self, df=df)

    def select(self, **bands: Column) -> Grid:
        return self.with_df(self.df.select(*PIXEL, *[c.alias(n) for n, c in bands.items()]))


def lattice(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """All pixels of the tiles in ``tiles`` (z, x, y)."""
    rows = tiles.select(*TILE, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("py"))
    return rows.select(*TILE, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("px"), "py")


def one_tile(spark: SparkSession, z: int = 0, x: int = 0, y: int = 0) -> DataFrame:
    return spark.range(1).select(F.lit(z).alias("z"), F.lit(x).alias("x"), F.lit(y).alias("y"))


def tasks(df: DataFrame) -> int:
    """Into how many tasks rows are dealt of which much more is made: as many as shuffles have, but not fewer than ``TASKS``.

    What a task sorts and counts is held in memory at once, for all its windows and groupings together.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt by tile into many tasks: what these make of them may be far larger.

    By x and y alone, which windows and groupings within tiles take as they are even where z is one number.
    """
    return df.repartition(tasks(df), "x", "y")


def dense(grid: Grid) -> Grid:
    """Every pixel of every tile that has any: missing samples as null, blank pixels as zeros.

    Rows are dealt by tile once; a pixel then also stands for the blank ones up to the next, the first of a tile for those
    before it. Later windows and groupings within tiles shuffle nothing either.
    """
    df = dealt(grid.df.select(*PIXEL, *grid.bands)).groupBy(*PIXEL).agg(*[F.max(b).alias(b) for b in grid.bands])
    inside = F.col("px").between(0, grid.width - 1) & F.col("py").between(0, grid.height - 1)
    own, order = F.col("own"), Window.partitionBy(*TILE).orderBy("own")
    df = df.where(inside).withColumn("own", F.col("py") * grid.width + F.col("px"))
    df = df.withColumns({"first": F.lag("own").over(order).isNull(), "next": F.lead("own", 1, grid.width * grid.height).over(order)})
    df = df.withColumn("at", F.explode(F.sequence(F.when(F.col("first"), 0).otherwise(own), F.col("next") - 1)))
    place = ((F.col("at") % grid.width).cast("int").alias("px"), F.floor(F.col("at") / grid.width).cast("int").alias("py"))
    out = df.select(*TILE, *place, *[F.when(F.col("at") == own, F.col(b)).alias(b) for b in grid.bands])
    return grid.with_df(out if "v" in grid.bands else out.fillna(0, list(grid.bands)))


def _line(along: str, across: str):
    return Window.partitionBy(*TILE, across).orderBy(along)


NEAR = ("nw", "n", "ne", "w", "c", "e", "sw", "s", "se")


def neighbourhoods(grid: Grid) -> DataFrame:
    """The dense grid with the 3 x 3 neighbours of every band as band_nw, band_n ... band_se; edges repeat."""
    g = dense(grid)

    def beside_edge(axis: str, size: int, step: int, name: str) -> Column:
        line = _line(axis, "py" if axis == "px" else "px")
        near = (F.lag if step < 0 else F.lead)(name, 1).over(line)
        return F.when(F.col(axis) == (0 if step < 0 else size - 1), F.col(name)).otherwise(near)

    df = g.df.withColumns({f"{b}_c": F.col(b) for b in grid.bands})
    sides = ((-1, "w"), (1, "e"))
    df = df.withColumns({f"{b}_{k}": beside_edge("px", g.width, step, f"{b}_c") for b in grid.bands for step, k in sides})
    ends = ((-1, ("nw", "n", "ne")), (1, ("sw", "s", "se")))
    up = {f"{b}_{new}": beside_edge("py", g.height, step, f"{b}_{old}") for b in grid.bands for step, names in ends for new, old in zip(names, "wce")}
    return df.withColumns(up)


def neighbourhood(grid: Grid, column: str = "v") -> DataFrame:
    """The dense grid with the neighbours of one band as nw, n, ne, w, c, e, sw, s, se."""
    df = neighbourhoods(grid.with_df(grid.df.select(*PIXEL, column)))
    return df.select(*PIXEL, column, *[F.col(f"{column}_{k}").alias(k) for k in NEAR])


def per_tile(grid: Grid, kernel: Callable, schema: str) -> DataFrame:
    """Run ``kernel(dict of band -> 2D numpy array, (z, x, y)) -> dict of band -> 2D array`` on each whole tile.

    For kernels that are sequential over a tile's pixels. A tile is the unit of evaluation and of fixed size.
    """
    import numpy as np
    import pandas as pd

    width, height, bands = grid.width, grid.height, grid.bands
    out_bands = [c.split()[0] for c in schema.split(",")]

    def run(key, pdf):
        planes = {}
        for b in bands:
            plane = np.full((height, width), np.nan if b == "v" else 0.0)
            plane[pdf["py"], pdf["px"]] = pdf[b]
            planes[b] = plane
        found = kernel(planes, key)
        py, px = np.mgrid[0:height, 0:width]
        out = {"z": key[0], "x": key[1], "y": key[2], "px": px.ravel(), "py": py.ravel()}
        return pd.DataFrame(out | {b: found[b].ravel() for b in out_bands})

    return grid.df.groupBy(*TILE).applyInPandas(run, f"z int, x int, y int, px int, py int, {schema}")
