"""Batch retrieval over evidence documents: routing, filtered top-k, ranking, verdicts."""
