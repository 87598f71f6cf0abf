"""Citation resolution and passage search over addressable corpora, on Spark DataFrames."""
