"""Incremental forms for Structured Streaming."""
