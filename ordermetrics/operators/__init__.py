"""Frame-level building blocks: joins, distinct counts, ranking, spines, trends."""
