"""Operators for large training-text pipelines, one module per operator.

Nothing else in the library imports this subpackage; the registered queries
and their SQL are in ``queries``.
"""
