"""cairn: a PySpark-native engine for code retrieval, memory-aware re-ranking and training-data work."""
