"""Document search analytics and training-data preparation on PySpark."""
