"""The stateless operators and the word count on streaming DataFrames."""
