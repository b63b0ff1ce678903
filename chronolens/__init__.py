"""chronolens: point-in-time analytics and null-model testing on Spark DataFrames."""

__version__ = "0.1.0"
