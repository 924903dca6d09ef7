"""Grid and gauge time-series analytics as PySpark DataFrame operators."""
