"""Admissions analytics on Spark: an additive pay cube and the queries, repairs and models on top of it."""

__version__ = "0.1.0"
