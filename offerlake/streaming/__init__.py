"""Structured Streaming forms of ingestion, health and query-log analysis."""
