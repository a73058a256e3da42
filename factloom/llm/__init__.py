"""Operators for the making of training data. Nothing outside imports this package."""
