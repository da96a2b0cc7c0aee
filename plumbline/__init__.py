"""Retrieval and record analytics over nested entity records, planned by Spark."""

__version__ = "0.1.0"
