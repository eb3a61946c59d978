"""plinth: building-footprint analytics as PySpark DataFrame plans."""
