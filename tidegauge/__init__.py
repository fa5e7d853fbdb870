"""Attention analytics as Spark DataFrame operators and Structured Streaming jobs."""
