"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; every module has a general
DataFrame interface, and :mod:`tallyloom.llm.queries` holds the thin queries.
"""
