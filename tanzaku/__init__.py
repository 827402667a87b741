"""tanzaku: a PySpark-native engine for preference ranking, scoped retrieval and catalogue ETL."""

__version__ = "0.1.0"
