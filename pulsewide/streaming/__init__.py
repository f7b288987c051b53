"""Structured Streaming form of Live scoring."""
