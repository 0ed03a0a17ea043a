"""Incremental cleaning and scoring: stateless projections on Structured Streaming."""
