"""Readers, writers, and the logical tables derived from the given Parquet tables."""
