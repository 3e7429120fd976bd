"""Client-level credit-risk features, scoring and monitoring on Spark DataFrames."""

__version__ = "0.1.0"
