"""Structured Streaming forms of the alert and status-count views."""
