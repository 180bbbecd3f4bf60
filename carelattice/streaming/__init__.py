"""Structured Streaming forms of the message and state operators."""
