"""Operators for preparing listing text as training data (one module a problem)."""
