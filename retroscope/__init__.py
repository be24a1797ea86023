"""Causal analogue analytics and panel operators on Spark DataFrames."""
