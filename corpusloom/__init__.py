"""corpusloom: retrieval, evaluation and corpus processing on Spark DataFrames."""
