"""Sources of the bid-log library."""
