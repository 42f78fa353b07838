"""Flow-log analytics on Spark: deduplication, detection, evaluation tables."""
