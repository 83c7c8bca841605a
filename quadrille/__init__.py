"""A graph-query and data-processing engine on PySpark DataFrames."""
