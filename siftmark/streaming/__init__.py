"""Structured Streaming forms of the epoch selector and the alarm filter."""
