"""Composed plans over the driver's tables, and their DuckDB equivalents."""
