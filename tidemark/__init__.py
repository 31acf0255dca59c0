"""Tidemark: text and market-intelligence analytics as composable Spark DataFrame transformations."""

__version__ = "0.3.0"
