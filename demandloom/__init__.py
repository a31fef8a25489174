"""Demand analytics as Spark DataFrame jobs."""
