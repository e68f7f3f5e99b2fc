"""Structured Streaming: followed logs, windows, keyed release in order."""
