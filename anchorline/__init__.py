"""Point-in-time analytics over per-entity event histories, as Spark DataFrames."""

__version__ = "0.1.0"
