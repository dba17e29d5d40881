"""Scalar functions as Column expressions, and driver-side translators."""
