"""Scalar functions on text, arrays and signals."""
