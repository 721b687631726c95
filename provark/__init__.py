"""provark."""
