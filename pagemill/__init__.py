"""pagemill: document assembly and page-text processing on Spark DataFrames."""

__version__ = "0.1.0"
