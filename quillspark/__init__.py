"""Manuscript-corpus analytics on Spark."""
