"""Sources and sinks: parquet tables, customer files (CSV/JSON), exports, prediction merge."""
