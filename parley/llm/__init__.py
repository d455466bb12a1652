"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; :mod:`parley.llm.queries` applies each one to its whole table.
"""
