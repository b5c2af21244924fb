"""corpuslane: knowledge-base analytics as Spark DataFrame jobs."""
