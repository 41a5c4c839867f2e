"""A PySpark-native engine for extracting, cleaning, scoring and consolidating records."""
