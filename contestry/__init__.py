"""Contest analytics expressed as Spark DataFrame jobs."""
