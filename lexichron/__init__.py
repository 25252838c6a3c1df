"""Diachronic corpus analytics on Spark DataFrames."""
