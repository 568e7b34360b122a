"""Operators for text and training data. Nothing else in the package imports this one."""
