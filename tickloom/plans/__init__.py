"""Named queries: each pairs a Spark plan with its oracle SQL."""
