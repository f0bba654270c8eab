"""Registered queries of the spatial engine and their SQL."""

from .plans import border_queries, io_queries, queries

PAIRS = queries.PAIRS | io_queries.PAIRS | border_queries.PAIRS | {"grid_scan": (io_queries.grid_scan, queries.GRID_REFINED), "grid_source": (io_queries.grid_source, queries.GRID_REFINED)}
QUERIES = {name: query for name, (query, _) in PAIRS.items()}
ORACLE = {name: sql for name, (_, sql) in PAIRS.items()}
