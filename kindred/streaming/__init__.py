"""Structured Streaming over items that are still arriving."""
