"""Operators for preparing training data, and the queries that apply them.

Nothing outside this package imports it. Each operator module has a general interface on
DataFrames; ``queries.py`` derives the registered queries from them.
"""
