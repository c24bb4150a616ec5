"""Operators over documents, segments and pairs; each takes and gives DataFrames."""
