"""Spark-native document pipeline: merge search hits, extract pages, group duplicates."""
