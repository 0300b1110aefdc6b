"""Compositions: ingestion and retrieval end to end, with their settings."""
