"""Operators over lineage data: evolution, biopsies, distances, reconstruction, similarity and summaries."""
