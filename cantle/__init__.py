"""Cantle: polygon-to-token sequence analytics and text-corpus operators on PySpark."""

__version__ = "0.1.0"
