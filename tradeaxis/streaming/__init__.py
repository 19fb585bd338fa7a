"""Structured Streaming forms of late-arrival upsert and journal progress."""
