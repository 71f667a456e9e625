"""Operators for preparing large text corpora as training data.

Each module holds one operator with its own general interface; ``queries``
registers the thin driver queries over the synthetic tables.  Nothing outside
this subpackage imports it.
"""
