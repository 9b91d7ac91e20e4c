"""Sinks: stored tables and exports."""
