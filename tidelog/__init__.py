"""tidelog: a message log expressed as Spark DataFrames."""
