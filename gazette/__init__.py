"""gazette: analytics over regulatory document records, built on Spark DataFrames."""
