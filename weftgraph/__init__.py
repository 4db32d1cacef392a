"""weftgraph: a Spark-native analytics engine for code and document knowledge graphs."""

__version__ = "0.1.0"
