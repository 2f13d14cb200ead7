"""Spark-native document corpus engine: web pages, Markdown documents and wiki storage pages as DataFrames."""
