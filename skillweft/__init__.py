"""Skillweft: labour-market analytics and corpus preparation on Spark DataFrames."""
