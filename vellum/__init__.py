"""Vellum: document intelligence on Spark DataFrames."""
