"""Siftwave: a PySpark-native engine for event search, reports and corpus preparation."""
