"""Detection, explanation-quality and retrieval analytics as Spark DataFrame jobs."""
