"""sources of the structural engine."""
