"""Market-data and strategy-evaluation analytics on Spark DataFrames."""

__version__ = "0.1.0"
