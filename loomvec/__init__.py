"""Vector compression, compressed search and corpus operators on PySpark DataFrames."""
