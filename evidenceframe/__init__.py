"""Evidence aggregation and evaluation analytics as Spark DataFrames."""
