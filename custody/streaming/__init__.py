"""Polling pipelines on Structured Streaming."""
