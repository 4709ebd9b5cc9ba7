"""Measures over streams."""
