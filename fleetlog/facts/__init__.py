"""Facts: correlations, per-dump health numbers and roll-ups over the domain tables."""
