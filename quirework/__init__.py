"""Structure-aware document preprocessing on Spark DataFrames."""
