"""wayfold: a Spark-first engine for GPS activity data."""
