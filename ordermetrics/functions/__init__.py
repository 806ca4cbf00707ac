"""Column-level building blocks: predicates, time buckets, scalars, labels."""
