"""Named analyses, the query registry used by ``__spark_entry__`` and the DuckDB oracle SQL."""
