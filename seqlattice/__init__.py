"""Probabilistic short-read alignment analytics as Spark jobs."""
