"""Spark-native analytics for measuring prompt-cache reuse in language-model serving."""
