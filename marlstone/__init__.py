"""Marlstone: a Spark engine for document evidence and training-data preparation."""
