"""Curation of ordered episodes and of text on Spark."""
