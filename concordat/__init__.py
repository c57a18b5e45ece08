"""State reconciliation, change-feed and hierarchy analytics as Spark jobs."""
