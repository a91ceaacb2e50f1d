"""Incremental runs with Structured Streaming."""
