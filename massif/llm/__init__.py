"""Operators for training-corpus preparation. Nothing else in the library imports this subpackage."""
