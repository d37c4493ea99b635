"""Structured Streaming counterparts of the event and state operators."""
