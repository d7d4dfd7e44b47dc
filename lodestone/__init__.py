"""Retrieval, evaluation and corpus operators as Spark jobs."""
