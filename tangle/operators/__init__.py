"""Operators of the class-overlap engine."""
