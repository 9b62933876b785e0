"""Tessera: evidence tables over document collections, declared as Spark DataFrames."""
