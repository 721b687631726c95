"""provark.sources."""
