"""Fact tables about code and text corpora, computed, joined and queried with Spark DataFrames."""
