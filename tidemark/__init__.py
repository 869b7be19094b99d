"""A PySpark-native analytics engine for event histories."""
