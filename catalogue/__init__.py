"""Checked queries: the engine's operators over the driver's tables, with DuckDB twins."""
