"""plans of the structural engine."""
