"""millrace: product-content extraction, cleaning and quality operators on Spark DataFrames."""

__version__ = "0.1.0"
