"""Readers and writers for results, partitioned datasets and embedding stores."""
