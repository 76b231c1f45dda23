"""tabulon: tabular profiling, cleaning, feature and clustering operators on Spark DataFrames."""
