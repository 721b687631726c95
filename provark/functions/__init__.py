"""provark.functions."""
