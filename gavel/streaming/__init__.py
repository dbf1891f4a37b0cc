"""Streaming of the bid-log library."""
