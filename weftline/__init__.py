"""weftline: a PySpark-native engine for versioned web corpora."""

__version__ = "0.1.0"
