"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes
and returns DataFrames; column names that an operator adds win over columns
of the same name in its input.
"""
