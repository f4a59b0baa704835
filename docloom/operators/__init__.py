"""Operators from DataFrames to DataFrames: corpus, chunks, index, retrieval, context, citations."""
