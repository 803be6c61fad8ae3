"""folioweave: a Spark-native engine for long-context text data."""
