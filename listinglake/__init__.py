"""Event listings kept as an append-only log, processed as Spark jobs."""
