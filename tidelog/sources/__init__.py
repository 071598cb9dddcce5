"""Readers, record assembly, ingest defaults and day-partitioned tables."""
