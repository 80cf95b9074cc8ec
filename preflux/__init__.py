"""preflux: preference analytics over an embedded text corpus, on Spark DataFrames."""
