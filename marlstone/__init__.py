"""Spark-native analytics for entity value scoring: operators, sources, functions, plans, streaming."""
