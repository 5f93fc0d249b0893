"""Marker-density phenotype-prediction analytics on Spark DataFrames."""
