"""Strandline: a Spark-native engine that re-lays time-stepped files out as per-variable series."""
