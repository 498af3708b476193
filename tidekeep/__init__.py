"""Table snapshots and backup-fleet analytics as Spark jobs."""
