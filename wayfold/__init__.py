"""wayfold: a Spark-native engine for trajectory analytics."""
