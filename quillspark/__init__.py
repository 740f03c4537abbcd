"""Spark-native analytics over scholarly corpora: text search, graphs, evaluation and profiling."""
