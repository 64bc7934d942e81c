"""Incremental feeds on Structured Streaming."""
