"""visitframe: point-in-time analytics for longitudinal tables, on Spark DataFrames."""

__version__ = "0.1.0"
