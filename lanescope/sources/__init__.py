"""Sources and sinks: staging schema, CSV/Parquet I/O, the clean-table store, test-data adapter."""
