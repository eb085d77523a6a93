"""Structured Streaming operators; each has a batch twin with the same result."""
