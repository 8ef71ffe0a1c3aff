"""Whole runs: the daily pipeline and the shared working copy of its tables."""
