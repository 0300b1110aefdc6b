"""Operators over DataFrames: structure, chunks, index, retrieval, domains, answers."""
