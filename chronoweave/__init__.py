"""Temporal, interval, sequence and matching operators on Spark DataFrames."""
