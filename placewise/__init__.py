"""placewise: a PySpark-native engine for geographic and statistical place data."""
