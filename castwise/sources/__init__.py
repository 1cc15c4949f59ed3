"""Sources and sinks: driver tables, role views, CSV/parquet files, logs."""
