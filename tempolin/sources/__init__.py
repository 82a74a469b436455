"""Recorded sessions as tables, and results as JSON."""
