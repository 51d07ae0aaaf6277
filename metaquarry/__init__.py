"""A metadata catalogue, lineage and corpus engine built on the DataFrame API of Spark."""

__version__ = "0.1.0"
