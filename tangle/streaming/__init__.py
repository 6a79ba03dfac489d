"""Streaming of the class-overlap engine."""
