"""Incremental, content-addressed data pipelines and their queries on Spark DataFrames."""
