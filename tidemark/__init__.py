"""Tidemark: analytics over ordered event logs, on Spark DataFrames."""
