"""Incremental cohort statistics over arriving files."""
