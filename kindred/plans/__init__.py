"""Whole runs: configuration, the batch pipeline, staged deduplication."""
