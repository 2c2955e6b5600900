"""Independent SQL for DuckDB, one statement per registered query."""
