"""Scalar functions built from Column expressions."""
