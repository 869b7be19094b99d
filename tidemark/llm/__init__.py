"""Operators that a large-scale training-data pipeline needs, each a Spark job over whole tables."""
