"""Structured Streaming form of the file scan."""
