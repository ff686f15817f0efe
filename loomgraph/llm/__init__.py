"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator,
its thin contract query and, where SQL can express it, the DuckDB twin.
"""
