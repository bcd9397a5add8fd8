"""Operators for preparing large text collections as training data.

Nothing else in the library imports this subpackage.
"""
