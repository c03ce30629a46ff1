"""Spatial coupling analytics on Spark."""
