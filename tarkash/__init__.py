"""Lexicon building, candidate ranking and evaluation on Spark DataFrames."""
