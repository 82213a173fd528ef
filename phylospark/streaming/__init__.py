"""Structured Streaming forms of steps that follow event time."""
