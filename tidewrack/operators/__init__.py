"""DataFrame -> DataFrame operators with explicit ordering and grouping keys."""
