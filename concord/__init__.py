"""Record reconciliation as Spark jobs."""
