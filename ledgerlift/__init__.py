"""Statement extraction and training-data preparation on Spark DataFrames."""
