"""Discriminative learning on Spark DataFrames."""
