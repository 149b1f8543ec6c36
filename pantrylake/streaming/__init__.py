"""Structured Streaming: ingestion, rolling state, windows."""
