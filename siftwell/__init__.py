"""siftwell: a Spark-native hybrid retrieval and corpus engine."""
