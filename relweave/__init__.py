"""A PySpark-native engine for analysing similarity over relational data."""
