"""Operators of the bid-log library."""
