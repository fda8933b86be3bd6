"""Incremental ingest with Structured Streaming."""

from cohort_spark.streaming.ingest import read_ingested, read_quarantine, stream_variants

__all__ = ["read_ingested", "read_quarantine", "stream_variants"]
