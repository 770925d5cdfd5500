"""tessera: tiled map-feature and raster-field analytics as PySpark DataFrames."""
