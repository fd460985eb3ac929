"""Spark-native data preparation, profiling, evaluation and evolutionary search over DataFrames."""
