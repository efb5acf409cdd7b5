"""Operators for preparing large text corpora, one module per operator.

Nothing outside this subpackage imports it. Each operator takes DataFrames and
column names, and returns DataFrames; `queries` registers thin queries over the
test tables.
"""
