"""sievelake: a Spark-native retrieval-analytics and document-quality engine."""
