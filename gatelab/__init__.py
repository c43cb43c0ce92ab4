"""Listening-experiment analytics on Spark."""
