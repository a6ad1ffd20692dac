"""laddersmith: a Spark-native rating analytics engine for competitive team games."""

__version__ = "0.1.0"
