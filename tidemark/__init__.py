"""A PySpark-native engine for behavioural event analytics."""
