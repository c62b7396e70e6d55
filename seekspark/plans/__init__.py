"""Searches composed from operators."""
