"""Assessment-scan analytics as Spark DataFrame jobs."""
