"""Operators of a large-scale training-data pipeline. Nothing outside this package imports it."""
