"""provark.plans."""
