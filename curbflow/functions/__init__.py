"""Column expressions: time parts, text, raster arithmetic, geometry, projections."""
