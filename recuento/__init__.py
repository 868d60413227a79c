"""recuento: registry cleaning and census comparison on Spark DataFrames."""

__version__ = "0.1.0"
