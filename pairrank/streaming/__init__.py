"""Structured Streaming forms of the monitoring aggregates."""
