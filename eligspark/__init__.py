"""eligspark: retrieval, three-valued rule matching and evaluation analytics on Spark DataFrames."""

__version__ = "0.1.0"
