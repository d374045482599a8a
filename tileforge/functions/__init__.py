"""Functions of the raster analytics library."""
