"""Tracewright: design-data analytics as Spark DataFrame jobs."""
