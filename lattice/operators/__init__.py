"""operators of the structural engine."""
