"""Building and analysing phonetic speech corpora with Spark DataFrames."""
