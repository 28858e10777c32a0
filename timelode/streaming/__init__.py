"""Structured Streaming jobs over the event log."""
