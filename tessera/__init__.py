"""tessera: a PySpark-native analytics engine for developer-activity and code-knowledge data."""

__version__ = "0.1.0"
