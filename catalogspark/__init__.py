"""Batch and streaming Spark jobs over large revisioned catalogs."""
