"""Structured Streaming jobs over access events."""
