"""Effective numbers of distinct linguistic units, computed with Spark."""
