"""streaming of the structural engine."""
