"""Streaming of the raster analytics library."""
