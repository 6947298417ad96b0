"""Operators for building language-model training data.

Nothing else in the package imports this folder. Every operator takes and returns
DataFrames, reads whole texts, and keeps its own column names apart from those of the
caller by selecting what it needs (or by carrying the caller's row as one struct).
"""
