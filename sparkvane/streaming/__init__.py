"""Structured Streaming: ingest and scene tracking."""
