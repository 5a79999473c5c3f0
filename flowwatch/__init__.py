"""Benign-only anomaly detection on flow tables and score streams, as Spark jobs."""

__version__ = "0.1.0"
