"""A PySpark-native engine for detector analytics."""
