"""Evidra: a PySpark-native engine for discussion-evidence data."""

__version__ = "0.1.0"
