"""Operators over streams of documents."""
