"""Retail revenue monitoring as Spark DataFrame jobs."""
