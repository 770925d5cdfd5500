"""Streaming forms of the tile aggregates. The operators themselves are batch; this is an extra of our own."""
