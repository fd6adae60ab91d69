"""Operators for large training-data pipelines: cleaning, de-duplication, mixing, scoring and encoding."""
