"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` binds its operators to
the tables, and the entry module adds those queries when the subpackage is present.
"""
