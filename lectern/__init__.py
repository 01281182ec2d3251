"""Text and dictionary analytics as Spark DataFrame operations."""
