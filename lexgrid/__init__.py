"""Full-text search and ranking on PySpark."""
