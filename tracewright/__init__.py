"""Tracewright: a Spark-native engine for fusing, linking and tracing activity records."""

__version__ = "0.1.0"
