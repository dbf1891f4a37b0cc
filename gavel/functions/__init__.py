"""Functions of the bid-log library."""
