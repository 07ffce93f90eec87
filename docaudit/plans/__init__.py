"""Catalogue queries with their DuckDB equivalents."""
