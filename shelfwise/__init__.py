"""Retail recommendation analytics as Spark DataFrame jobs."""
