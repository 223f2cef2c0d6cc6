"""Usage and cost analytics for request logs, expressed as Spark DataFrame jobs."""
