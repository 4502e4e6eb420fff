"""Matching and screening of candidates against jobs, as Spark DataFrame operators."""

__version__ = "0.1.0"
