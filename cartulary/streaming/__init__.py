"""Structured Streaming over a landing folder."""
