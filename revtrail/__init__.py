"""Document-revision analytics on Spark."""
