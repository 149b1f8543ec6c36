"""A PySpark-native analytics engine for purchasing and food operations."""
