"""Claims denial and recovery analytics as PySpark DataFrame operators."""
