"""knotwork: a PySpark-native knowledge-graph and retrieval engine."""

__version__ = "0.1.0"
