"""A PySpark-native engine that finds personal data in text and masks it reversibly."""
