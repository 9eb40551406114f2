"""itemforge: question-bank analytics over Spark DataFrames."""
