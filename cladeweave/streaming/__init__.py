"""Incremental (Structured Streaming) helpers."""
