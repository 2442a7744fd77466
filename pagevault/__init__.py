"""Spark-first collection, storage and querying of raw web pages."""
