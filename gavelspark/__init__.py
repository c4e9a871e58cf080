"""Spark-first engine for evaluating models that judge candidate answers."""

__version__ = "0.1.0"
