"""Corpus-membership analytics as Spark DataFrame jobs."""
