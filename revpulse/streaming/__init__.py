"""Continuous ingest: the batch operators as Structured Streaming queries."""
