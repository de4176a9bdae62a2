"""A Spark-native engine for building, cleaning and querying knowledge graphs over text and tables."""
