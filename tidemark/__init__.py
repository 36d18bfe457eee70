"""Tidemark: version-alignment analytics on Spark."""
