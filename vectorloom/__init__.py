"""Embedding retrieval, its evaluation and its query-log analysis as Spark DataFrame operators."""

__version__ = "0.1.0"
