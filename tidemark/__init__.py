"""Table and event-time analytics written as Spark DataFrame jobs."""
