"""A Spark-first engine for ordered text, interval and event data."""
