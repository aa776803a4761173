"""docspark: a PySpark-native engine for parsing, checking and reshaping document collections."""

__version__ = "0.1.0"
