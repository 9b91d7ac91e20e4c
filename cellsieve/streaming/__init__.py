"""Validation of streaming tables."""
