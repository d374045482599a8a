"""Sources of the raster analytics library."""
