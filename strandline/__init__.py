"""Evidence retrieval over corpora of immutable text records, on Spark DataFrames."""
