"""Jobs of the raster analytics library."""
