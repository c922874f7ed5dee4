"""Folioforge: a PySpark-native engine for document corpora and replicated reading state."""

__version__ = "0.1.0"
