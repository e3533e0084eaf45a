"""Batch quality-control analytics on Spark."""
