"""Structured Streaming versions of the ingest and rating jobs."""
