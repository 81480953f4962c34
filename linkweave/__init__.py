"""Entity resolution as Spark jobs."""
