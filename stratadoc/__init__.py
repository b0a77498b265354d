"""A document engine on Spark: schemaless JSON records, indexed by every field path, queried as DataFrames."""

__version__ = "0.2.0"
