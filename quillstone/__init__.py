"""Quillstone: a PySpark-native analytics engine for recorded responses, documents and event snapshots."""

__version__ = "0.1.0"
