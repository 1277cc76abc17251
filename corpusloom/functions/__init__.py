"""Column functions: each takes and returns columns."""
