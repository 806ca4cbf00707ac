"""Reading source tables and keeping snapshots of query results."""
