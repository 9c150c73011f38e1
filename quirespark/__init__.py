"""Document-collection analytics as PySpark DataFrame operators."""
