"""Spark jobs that guard the path from warehouse tables to machine-learning models."""
