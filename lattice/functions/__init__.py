"""functions of the structural engine."""
