"""lapforge: lap-level motorsport timing analytics on Spark DataFrames."""

__version__ = "0.1.0"
