"""Column functions: arithmetic, Mercator, colours, expressions."""
