"""Named queries (Spark side), their DuckDB oracles, and batch jobs."""
