"""Whole pipelines, and the queries with their SQL."""
