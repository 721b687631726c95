"""provark.streaming."""
