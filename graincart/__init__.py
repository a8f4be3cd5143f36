"""graincart: a PySpark-native engine that turns raw tables into training data."""
