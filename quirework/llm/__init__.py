"""Corpus operators for training data: one module per operator, `queries` registers them.

Nothing else in the package imports this subpackage.
"""
