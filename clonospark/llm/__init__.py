"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it. Every operator is a function from
DataFrames to a DataFrame; intermediate results that are read twice are written
to the shared checkpoint folder (see ``shared``), never to executor disks.
"""
