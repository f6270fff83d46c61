"""Spark-native auditing of generated reports against reference reports."""
