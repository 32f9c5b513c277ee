"""Structured Streaming forms of the request-log and run operators."""
