"""Structured Streaming counterparts of the batch store."""
