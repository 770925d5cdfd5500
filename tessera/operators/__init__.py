"""One module per family of operators; each takes and returns DataFrames keyed by tile (z, x, y)."""
