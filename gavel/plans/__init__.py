"""Plans of the bid-log library."""
