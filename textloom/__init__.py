"""Text retrieval, grounding and corpus building on Spark DataFrames."""
