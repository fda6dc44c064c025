"""Continuous ingest and the asynchronous facade."""
