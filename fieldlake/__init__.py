"""fieldlake: field, spectrum and particle analytics on Spark DataFrames."""
