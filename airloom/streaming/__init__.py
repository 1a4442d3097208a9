"""Structured Streaming forms of the ingest and the daily aggregates."""
