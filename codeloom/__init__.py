"""Spark-native preparation of source-code corpora for code-completion models."""
