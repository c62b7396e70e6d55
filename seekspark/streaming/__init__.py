"""Structured Streaming over query logs."""
