"""stacklight: a Spark-native retrieval and text-analytics engine."""
