"""A PySpark-native engine over tables of fetched web pages."""
