"""Bilingual document processing and translation quality analysis on Spark."""

__version__ = "0.1.0"
