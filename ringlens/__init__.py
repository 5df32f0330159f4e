"""Call analytics on Spark: DataFrame -> DataFrame operators."""

__version__ = "0.1.0"
