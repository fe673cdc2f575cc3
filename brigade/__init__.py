"""brigade: restaurant and point-of-sale analytics as Spark DataFrame jobs."""
