"""Document-corpus retrieval and change tracking as Spark DataFrame jobs."""
