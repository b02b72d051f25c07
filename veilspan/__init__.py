"""Spark-native detection, matching and redaction of contact details in document collections."""

__version__ = "0.1.0"
