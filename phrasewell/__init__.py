"""Phrase-index analytics and corpus processing on Spark."""
