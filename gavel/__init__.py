"""Bid-log analytics as Spark jobs."""
