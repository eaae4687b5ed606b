"""A PySpark-native engine for versioned document corpora."""
