"""Structured Streaming forms of the event and listing operators."""
