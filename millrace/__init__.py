"""Document-corpus analytics and retrieval evaluation as Spark DataFrame plans."""
