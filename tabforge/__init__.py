"""Spark-native preparation, protection and assessment of private tables."""
