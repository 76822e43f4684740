"""Operators for preparing training data: one module per operator.

Nothing outside this subpackage imports it.  ``catalog`` lists its queries.
"""
