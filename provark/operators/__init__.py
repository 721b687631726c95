"""provark.operators."""
