"""Every registered query of the library with its SQL, by name."""

from __future__ import annotations

from brindle.plans import column_queries, raster_queries, request_queries, shape_queries, state_queries, workflow_queries

MODULES = (state_queries, raster_queries, shape_queries, workflow_queries, column_queries, request_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
FLAGSHIP = "list_projects_page"
