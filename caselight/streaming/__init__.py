"""Structured Streaming forms of intake, status, counts, audit and same-day checks."""
