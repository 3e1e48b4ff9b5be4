"""foliospark: Office Open XML packages as DataFrames, read, shredded and queried with Spark."""

__version__ = "0.1.0"
