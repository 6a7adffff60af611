"""A PySpark-native text-search and document-analytics engine."""
