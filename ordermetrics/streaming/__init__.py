"""Structured Streaming forms of the hourly refresh."""
from ordermetrics.streaming.refresh import (
    deduplicated,
    hourly_counts,
    ingest,
    rolling_counts,
    run_available,
    upsert_daily,
)

__all__ = ["deduplicated", "hourly_counts", "ingest", "rolling_counts", "run_available", "upsert_daily"]
