"""A point-cloud analytics engine on PySpark DataFrames."""
