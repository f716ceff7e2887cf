"""A Spark-first analytics engine for typed knowledge graphs and event data."""

__version__ = "0.1.0"
