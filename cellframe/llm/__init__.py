"""Operators for training-data pipelines over text corpora.

Nothing outside this subpackage imports it; see ``registry`` for the queries.
"""
