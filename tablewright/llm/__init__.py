"""Operators for preparing text corpora for model training.

Each module holds one operator over DataFrames; ``queries`` applies them to the
TESTDATA tables.  Nothing outside this subpackage imports it.
"""
