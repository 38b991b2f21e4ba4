"""Survey data-quality engine on PySpark DataFrames."""
