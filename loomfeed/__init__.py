"""loomfeed: a PySpark-native engine for feed, digest and corpus processing."""

__version__ = "0.1.0"
