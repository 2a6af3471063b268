"""Structured Streaming over the audit trail."""
