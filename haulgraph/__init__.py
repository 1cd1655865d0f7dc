"""Spark-first analytics engine for multi-commodity supply-route networks."""
