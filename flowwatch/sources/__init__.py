"""Readers, writers, parameter tables and views over the given tables."""
