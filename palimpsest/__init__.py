"""Spark-native revision attribution: who wrote, removed and restored each token."""
