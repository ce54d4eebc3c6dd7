"""docspark: a Spark-first retrieval, evaluation and object-catalog engine."""
