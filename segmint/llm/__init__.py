"""Operators for a large-scale training-data pipeline."""
