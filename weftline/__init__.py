"""Weftline: retrieval and analytics over source code, its history and texts about it, on Spark DataFrames."""
