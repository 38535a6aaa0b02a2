"""brindle: hybrid text and code retrieval analytics as PySpark DataFrames."""
