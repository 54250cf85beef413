"""Recall, guard and corpus operators on Spark DataFrames."""
