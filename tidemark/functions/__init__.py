"""Scalar expressions: their syntax tree, and their rendering as Spark SQL."""
