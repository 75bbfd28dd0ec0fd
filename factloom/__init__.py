"""factloom: a PySpark-native engine for building and auditing knowledge graphs from text."""

__version__ = "0.1.0"
