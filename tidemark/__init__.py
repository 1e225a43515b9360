"""Spark-native engine for causal time-series research and corpus preparation."""
