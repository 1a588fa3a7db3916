"""Column -> Column functions (pure projections; batch and streaming)."""
