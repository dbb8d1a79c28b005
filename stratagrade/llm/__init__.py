"""Training-data operators: thirteen steps that work on a `documents` table.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
parameters and returns DataFrames; `queries` binds them to the test tables.
"""
