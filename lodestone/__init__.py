"""lodestone: document retrieval, evaluation and memory tables as Spark jobs."""
