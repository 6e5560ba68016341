"""Operators for large text corpora (training-data pipelines).

Nothing outside this subpackage imports it.
"""
