"""Operators for large-scale training-data pipelines.

Every operator is a function from DataFrames to DataFrames; ``queries`` holds the thin ``opN_<name>``
queries over the driver's tables. Nothing outside this subpackage imports it.
"""
