"""lodestack: a Spark-first engine for source-code retrieval and review analytics."""
