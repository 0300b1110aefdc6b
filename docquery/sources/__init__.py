"""Readers of documents and the stores of chunks."""
