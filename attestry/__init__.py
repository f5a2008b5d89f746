"""attestry: governed knowledge analytics and retrieval on PySpark DataFrames."""
