"""Structured Streaming counterparts and log checks."""
