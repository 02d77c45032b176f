"""Relational code-risk analytics and corpus preparation on Spark DataFrames."""
