"""Continuous ingestion of triples with Structured Streaming."""
