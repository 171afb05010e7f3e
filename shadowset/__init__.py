"""Shadowset: relational profiling and synthetic tables on Spark."""

__version__ = "0.1.0"
