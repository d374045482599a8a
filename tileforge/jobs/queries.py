"""The registered queries of the raster jobs and the SQL that must agree with them."""

from __future__ import annotations

from . import alignment_queries, catalog_queries, evaluation_queries, geometry_queries, pixel_queries

FLAGSHIP = "ras097_class_report_rollup"
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (geometry_queries, pixel_queries, evaluation_queries, alignment_queries, catalog_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
