"""Indexing, change detection, search and evaluation on DataFrames."""
