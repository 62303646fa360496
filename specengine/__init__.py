"""Mass-spectrometry search and bulk text analytics on Spark DataFrames."""
