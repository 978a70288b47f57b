"""Spark-native curation of keyed, ordered series and of text corpora."""
