"""Operators of a training-data pipeline over large document tables.

Nothing outside this subpackage imports it; ``tomewatch.llm.queries`` holds the registered queries.
"""
