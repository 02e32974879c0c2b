"""Terrain analytics and least-cost access planning on Spark DataFrames."""
