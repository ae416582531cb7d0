"""Retrieval and document analytics as lazy Spark plans."""
