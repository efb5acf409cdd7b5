"""A PySpark-native engine for monitoring streams of text-heavy items."""
