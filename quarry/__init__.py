"""Match-results analytics as Spark jobs."""
