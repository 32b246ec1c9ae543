"""helixframe: a Spark-first toolkit for statistical genetics and sequence data."""

__version__ = "0.1.0"
