"""Structured Streaming: ingest, recomputation of touched buckets, live counts."""
