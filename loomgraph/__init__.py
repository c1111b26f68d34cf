"""loomgraph: a Spark-native engine that turns long texts into typed, queryable knowledge graphs."""

__version__ = "0.1.0"
