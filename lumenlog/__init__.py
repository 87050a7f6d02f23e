"""A deductive analytics engine on PySpark: rules in, DataFrames out."""

__version__ = "0.1.0"
