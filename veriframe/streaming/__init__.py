"""Structured Streaming versions of the append-only logs."""
