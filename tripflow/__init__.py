"""Trip-congestion analytics as Spark DataFrame jobs."""
