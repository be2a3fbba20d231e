"""Evidence-bounded analytics on Spark DataFrames."""
