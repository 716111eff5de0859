"""Structured Streaming over the logs of an index."""
