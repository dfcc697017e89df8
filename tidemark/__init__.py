"""Continuously maintained SQL results, and batch operators, on PySpark."""

__version__ = "0.1.0"
