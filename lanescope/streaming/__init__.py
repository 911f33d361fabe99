"""Incremental ingest and KPI maintenance with Structured Streaming."""
