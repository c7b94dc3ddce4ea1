"""A log analytics engine on Spark DataFrames: formats in, typed entries, a small query language, counts and exports out."""

__version__ = "0.1.0"
