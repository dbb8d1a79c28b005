"""Readers for tables, mappings and JSON arrays."""
