"""Operators over tables and issues: summaries, views, inference, matching."""
