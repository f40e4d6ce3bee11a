"""Operators for preparing training text at scale, one module per operator.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; its own docstring states the result for
nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns.
"""
