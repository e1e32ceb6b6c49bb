"""Operators for preparing training text, and their registered queries.

Nothing else in the package imports this subpackage.
"""
