"""A provenance-carrying knowledge-graph engine on Spark DataFrames."""
