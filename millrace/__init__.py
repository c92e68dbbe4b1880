"""millrace: a PySpark-native engine for document privacy, usage accounting and session analytics."""

__version__ = "0.1.0"
