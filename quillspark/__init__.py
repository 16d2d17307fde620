"""Document and table analytics as Spark jobs."""
