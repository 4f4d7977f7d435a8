"""A PySpark-native engine for auditing and summarising document collections."""
