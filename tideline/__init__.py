"""Hiring-signal analytics as set-based Spark jobs."""
