"""Catalog analytics on Spark: functions, sources, operators, plans and streaming jobs."""
