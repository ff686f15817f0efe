"""Logical tables, parsers, stores and sinks."""
