"""Tonearm: cleaning, matching and loading of music-catalog data on Spark DataFrames."""
