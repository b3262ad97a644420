"""pointlake: point-cloud analytics and normal orientation on Spark DataFrames."""

__version__ = "0.1.0"
