"""Stateful incremental processing with Structured Streaming."""
