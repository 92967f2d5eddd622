"""Operators for preparing training data, separate from the rest of the library."""
