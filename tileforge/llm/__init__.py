"""Operators of a training-data pipeline: sharding, deduplication, mixing, packing and text screens.

Nothing outside this folder imports it.
"""
