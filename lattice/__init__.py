"""lattice: a PySpark-native structural analytics engine."""
