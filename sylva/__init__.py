"""sylva: phylogenetic and sequence analytics on Spark DataFrames."""
