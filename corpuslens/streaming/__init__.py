"""Incremental flows as Structured Streaming queries."""
