"""Structured Streaming forms of ingest, aggregation and recovery."""
