"""Spark jobs for a health-data lake: landing, warehouse and serving loads, log measures, models."""
