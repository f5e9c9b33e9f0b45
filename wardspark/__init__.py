"""LLM-traffic security analytics as plain PySpark DataFrame jobs."""
