"""Operators of the raster analytics library."""
