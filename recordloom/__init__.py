"""Evidence-backed record pipelines as Spark DataFrames."""
