"""Operators for training data; the rest of the library doesn't need them."""
