"""Operators of a large-scale training-data pipeline; queries are in ``queries``."""
