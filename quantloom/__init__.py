"""Market analytics on PySpark: every operator is a DataFrame transformation."""
