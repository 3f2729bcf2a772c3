"""Part of the raster analytics package."""
