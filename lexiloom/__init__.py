"""Document-localization analytics as PySpark DataFrame operators."""
