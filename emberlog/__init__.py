"""Security-log analytics as Spark jobs."""
