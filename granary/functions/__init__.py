"""Scalar and aggregate functions by name."""
