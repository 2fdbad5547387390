"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator is a plain function from
DataFrames to a DataFrame; ``registry`` holds the thin queries over the test tables.
"""
