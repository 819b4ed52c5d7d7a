"""Retail demand and stock analytics as plain PySpark DataFrame jobs."""
