"""trestle: a Spark-native engine for document analytics."""
