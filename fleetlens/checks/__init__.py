"""Oracle SQL (DuckDB dialect) for each registered query: the reference's own
formulation of each report over the same derived telemetry."""
