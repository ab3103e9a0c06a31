"""Structured Streaming counterparts of the time aggregations."""
