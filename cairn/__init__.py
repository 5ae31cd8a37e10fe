"""cairn: a DataFrame-first engine for credit-risk features, data quality and evaluation on Spark."""

__version__ = "0.1.0"
