"""Operators for preparing large text collections for training.

Nothing else in the library imports this subpackage.
"""
