"""Property-market analytics as Spark jobs."""
