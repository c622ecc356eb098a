"""Operators for training-data pipelines; queries and SQL in ``queries``."""
