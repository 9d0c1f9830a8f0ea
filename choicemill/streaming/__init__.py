"""Structured Streaming forms of ingestion, scoring and completeness."""
