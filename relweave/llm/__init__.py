"""Operators for training-data pipelines, and the queries over them."""
