"""Readers and writers of the engine's files, all through Spark's own readers and writers."""
